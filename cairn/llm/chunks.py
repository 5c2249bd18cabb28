"""Places at which a text can be cut so that the tokens of its parts are those of the whole.

A single space between two characters that are no white space is such a place for three layouts of vocabulary files: words
found between white space, byte-level words that take one space before them, and pieces none of which runs from
a word into the space behind it, over text that is not normalised. Files of another layout are never cut for.
"""

from __future__ import annotations

import json
import os
import re

#: White space by Python's rule, which covers what the tokenizers take for it, and the character that stands for it in pieces.
SAFE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def stretches(text: str) -> list[str]:
    """The text cut at all its safe places."""
    plain = text.replace("\n", "").isprintable() and not any(x in text for x in ("▁", "  ", " \n", "\n "))  # white space is blanks and line ends
    return text.split(" ") if plain and text[:1] != " " and text[-1:] != " " else SAFE.split(text)


def sections(text: str, size: int) -> list[str]:
    """The text cut at safe places, which are dropped, into sections of about ``size`` characters; longer where no place is found."""
    out, at = [], 0
    while len(text) - at > size:
        place = SAFE.search(text, at + size - 1)
        if place is None:
            break
        out.append(text[at : place.start()])
        at = place.end()
    out.append(text[at:])
    return out


def json_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core for each task
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def piece_processor(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def json_layout(path: str) -> str | None:
    """``words``: white space is dropped; ``bytes``: a word takes the space before it along; None: not known to be safe."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if any(any(c.isspace() for c in t["content"]) or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]) or spec["post_processor"] and spec["post_processor"]["type"] != "ByteLevel":
        return None
    pre = spec["pre_tokenizer"] or {}
    parts = pre.get("pretokenizers", [pre])
    split = parts[0]
    if split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and len(parts) == 1 and spec["normalizer"] is None:
        return "bytes"
    kinds = {n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])}
    if split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and kinds <= {"NFC", "Replace", "Lowercase"}:
        dropped = json_tokenizer(path).pre_tokenizer.pre_tokenize_str("a a 1 1 . .")
        return "words" if len(dropped) == 6 else None
    return None


def piece_layout(path: str) -> bool:
    """Whether a file of pieces is over plain text with a space put before it, and no piece runs from a word into a space."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    n = model.normalizer_spec
    plain = n.name == "identity" and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces
    return plain and not any("▁" in p.piece.lstrip("▁") for p in model.pieces)
