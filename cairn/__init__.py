"""cairn: DataFrame operators for ordered measurement series and for auditing predictions on them."""
