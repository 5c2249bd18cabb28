"""I-Match document fingerprints in DataFrame functions only.

A document's terms are its distinct lower-cased words, as 64-bit hashes. Those whose document frequency over all documents
lies in a band of inverse document frequencies stay, are sorted, and are dealt by their leading bits to random subsets of the
lexicon, which part the whole band: every term is in exactly one subset. Each subset that holds any of the document's terms is a
slot: its number and the sum of its terms' hashes, so that a slot changes with any of its terms. The number of subsets is a power of
two that follows from the number of the document's distinct words, so that a slot holds one term or two in short texts and in
long ones; two documents are compared at the coarser of their numbers, to which the slots of the finer one add up.

The upper limit of the band counts groups of like texts, so that copies cannot push the terms they share over it; the lower
one counts rows. A text of few words keeps all of them; a longer one without a term in the band takes its terms of two or more
documents, or else all it has.

Terms are not looked up one by one: those over the band are few (the mean number of terms over ``MAX_SHARE``) and are taken
off in one array, those under it occur in one document and return to it alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.staging import Stage

#: Bits of the number of a slot, from and to, and of its hash; 31 together.
MIN_BITS, MAX_BITS, HASH_BITS = 5, 22, 9
#: Texts of fewer distinct words keep all of them.
FEW = 16
#: Terms of one subset are looked for so far ahead in the sorted array; a subset that goes on is read from the whole array.
AHEAD = 16
#: Texts are like if so many of as many keys, each of a run of terms in the order of their hashes, are the same.
KEYS, LIKE_KEYS = 8, 3
#: The weight of one group, in whole numbers so that sums do not depend on their order.
UNIT = 2**32
#: The band: terms of at least so many documents, and of at most this share of all.
MIN_DF = 2
MAX_SHARE = 0.05
#: Documents of neighbouring ids that are put in order together, about.
NEIGHBOURS = 256


def terms(text: Column) -> Column:
    """Hashes of the distinct words of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def bits_for(n_terms: Column) -> Column:
    """Bits of the number of subsets: as many subsets as words, or up to twice as many."""
    return F.least(F.lit(MAX_BITS), F.greatest(F.lit(MIN_BITS), F.ceil(F.log2(F.greatest(n_terms, F.lit(1)))))).cast("int")


def _shr(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by)


def sorted_terms(kept: Column) -> Column:
    """Terms as positive numbers in order, so that those of one subset, which share their leading bits, stand together."""
    return F.sort_array(F.transform(kept, lambda h: F.shiftrightunsigned(h, 1)))


def slots(terms_in_order: Column, shift: Column) -> Column:
    """For each subset that holds any of the terms its number, and behind it the sum of their hashes; in order. ``shift``: 63 less the bits."""
    u, most = terms_in_order, F.lit(2**HASH_BITS - 1)
    alike = lambda x, y: F.coalesce(_shr(x.bitwiseXOR(y), shift) == 0, F.lit(False))

    def slot(x: Column, i: Column) -> Column:
        total = lambda own: F.aggregate(own, F.lit(0), lambda s, y: (s + y.bitwiseAND(most).cast("int")).bitwiseAND(most))
        here = F.filter(F.slice(u, i + 1, F.lit(AHEAD)), lambda y: alike(x, y))
        own = F.when(alike(x, F.get(u, i + AHEAD)), F.filter(u, lambda y: alike(x, y))).otherwise(here)
        value = F.when(alike(x, F.get(u, i + 1)), total(own)).otherwise(x.bitwiseAND(most).cast("int"))
        return F.when(~alike(x, F.get(u, i - 1)), (_shr(x, shift) * 2**HASH_BITS).cast("int") + value)

    return F.filter(F.transform(u, slot), lambda v: v.isNotNull())


def with_terms(s: Column, bits: Column, more: Column) -> Column:
    """``s`` with a few more terms."""
    size, most = 2**HASH_BITS, F.lit(2**HASH_BITS - 1)
    new = slots(sorted_terms(more), F.lit(63) - bits)
    of = lambda v: F.shiftright(v, HASH_BITS)
    added = lambda v: F.aggregate(F.filter(new, lambda w: of(w) == of(v)), F.lit(0), lambda a, w: a + w.bitwiseAND(most))
    old = F.transform(s, lambda v: of(v) * size + (v.bitwiseAND(most) + added(v)).bitwiseAND(most))
    return F.when(F.size(more) == 0, s).otherwise(F.sort_array(F.concat(old, F.filter(new, lambda w: ~F.exists(s, lambda v: of(v) == of(w))))))


def coarser(s: Column, by: Column) -> Column:
    """The slots of 2 ** ``by`` neighbouring subsets added up."""
    size, most = 2**HASH_BITS, F.lit(2**HASH_BITS - 1)
    of = lambda v: _shr(v, by + HASH_BITS)

    def slot(v: Column, i: Column) -> Column:
        own = F.filter(F.slice(s, i + 1, _shl(F.lit(1), by)), lambda w: of(w) == of(v))
        value = F.aggregate(own, F.lit(0), lambda a, w: (a + w.bitwiseAND(most)).bitwiseAND(most))
        return F.when((i == 0) | (of(F.get(s, i - 1)) != of(v)), of(v) * size + value)

    return F.when(by <= 0, s).otherwise(F.filter(F.transform(s, slot), lambda v: v.isNotNull()))


def _shl(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, F.greatest(by, F.lit(0)))


def likeness(bits_a: Column, a: Column, bits_b: Column, b: Column) -> Column:
    """Share of equal slots among those that either document has, at the coarser of both numbers of subsets; 0 where there are none."""
    pair = F.array(F.struct(coarser(a, bits_a - bits_b).alias("a"), coarser(b, bits_b - bits_a).alias("b")))
    of = lambda x: F.transform(x, lambda v: F.shiftright(v, HASH_BITS))
    share = F.transform(pair, lambda p: F.size(F.array_intersect(p["a"], p["b"])) / F.size(F.array_union(of(p["a"]), of(p["b"]))))
    return F.when(F.size(a) + F.size(b) > 0, F.get(share, F.lit(0))).otherwise(F.lit(0.0))


def or_else(own: Column, every: Column, lone: Column) -> Column:
    """The terms in the band; of a text of few words all, without any in the band those of two or more documents, without these all."""
    shared = F.array_except(every, lone)
    return F.when(F.size(every) < FEW, every).when(F.size(own) > 0, own).when(F.size(shared) > 0, shared).otherwise(every)


def written(bits: Column, s: Column, text_hash: Column, bare: Column) -> Column:
    """The fingerprint as text, after ``=`` if no term is in the band; a document without a word has its whole text's hash instead."""
    hexed = F.array_join(F.transform(s, lambda x: F.lower(F.hex(x))), ".")
    lead = F.when(bare, F.lit("=")).otherwise(F.lit(""))
    none = s.isNull() | (F.size(s) == 0)
    return F.when(none, F.concat(F.lit("="), F.lower(F.lpad(F.hex(text_hash), 16, "0")))).otherwise(F.concat(lead, F.lpad(bits.cast("string"), 2, "0"), F.lit(":"), hexed))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, also where a lambda reads them again and again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def vocabulary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(h, df, id, k)``: every term with its document frequency; where that is 1, the id and text hash of its document."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    return src.select("id", F.xxhash64("t").alias("k"), F.explode(terms(F.col("t"))).alias("h")).groupBy("h").agg(F.count("*").alias("df"), F.min("id").alias("id"), F.min("k").alias("k"))


def like_keys(in_order: Column, starts: Column, some: Column) -> Column:
    """``(p, key)``: the hash of all terms at -1, and for each of ``KEYS`` places among all hashes that of the next ``some`` terms from there on."""
    ring = F.concat(in_order, F.slice(in_order, F.lit(1), some))
    keys = [F.struct(F.lit(p).alias("p"), F.xxhash64(F.lit(p), F.slice(ring, F.get(starts, F.lit(p)), some)).alias("key")) for p in range(KEYS)]
    return F.array(F.struct(F.lit(-1).alias("p"), F.xxhash64(F.lit(-1), in_order).alias("key")), *keys)


def group_sizes(docs: DataFrame, text_col: str, stage: Stage) -> DataFrame:
    """``(k, c)``: for texts (by their hash) like those of other rows the number of such rows.

    That number is of the rows with the same terms, or as many as agree with the row in the third most frequent of its keys. Near
    copies differ in a few keys and strangers agree in none or one, so each group adds about 1 to the sum of 1 / c.
    """
    src = held(docs.select(F.coalesce(text_col, F.lit("")).alias("t")), k=F.xxhash64("t"), ot=terms(F.col("t"))).where(F.size("ot") > 0)
    places = [F.lit(-(2**63) + p * (2**64 // KEYS)).cast("bigint") for p in range(KEYS)]
    src = held(src.select("k", "ot"), in_order=F.sort_array("ot"), marked=F.sort_array(F.concat("ot", F.array(*places))))
    starts = F.array(*((F.array_position("marked", place) - p).cast("int") for p, place in enumerate(places)))  # less the places before
    src = held(src.select("k", "in_order", "marked"), starts=starts, some=F.ceil(F.log2(F.size("in_order"))).cast("int") + 2)
    keys = src.select("k", F.inline(like_keys(F.col("in_order"), F.col("starts"), F.col("some")))).groupBy("k", "p", "key").agg(F.count("*").alias("n"))
    keys = stage.put(keys)
    many = stage.put(keys.groupBy("key").agg(F.sum("n").alias("c")).where("c > 1"))
    met = keys.join(many, "key").groupBy("k").agg(F.max(F.when(F.col("p") < 0, F.col("c"))).alias("same"), F.collect_list(F.when(F.col("p") >= 0, F.col("c"))).alias("cs"))
    like = F.coalesce(F.get(F.sort_array("cs", asc=False), F.lit(LIKE_KEYS - 1)), F.lit(1))
    return stage.put(met.select("k", F.greatest(F.coalesce("same", F.lit(1)), like).alias("c")).where("c > 1"))


def over(docs: DataFrame, vocab: DataFrame, text_col: str, stage: Stage, max_share: float = MAX_SHARE) -> DataFrame:
    """``(h)``: the terms of more groups of like texts than the band has; at most the mean number of terms of a document over ``max_share``."""
    limit = max(MIN_DF, int(max_share * docs.count()))
    often = stage.put(vocab.where(F.col("df") > limit).select("h"))
    if often.isEmpty():
        return often
    terms_of = held(docs.select(F.coalesce(text_col, F.lit("")).alias("t")).crossJoin(F.broadcast(often.agg(F.collect_list("h").alias("often")))), k=F.xxhash64("t"), own=F.array_intersect(terms(F.col("t")), "often"))
    each = terms_of.select("k", "own").join(group_sizes(docs, text_col, stage), "k", "left").select(F.explode("own").alias("h"), F.floor(F.lit(UNIT) / F.coalesce("c", F.lit(1))).cast("bigint").alias("w"))
    return stage.put(each.groupBy("h").agg(F.sum("w").alias("w")).where(F.col("w") > limit * UNIT).select("h"))


def band(docs: DataFrame, text_col: str = "text", min_df: int = MIN_DF, max_share: float = MAX_SHARE) -> DataFrame:
    """``(h)``: hashes of the terms in the band: of ``min_df`` rows at least, and of at most ``max_share`` as many groups of like texts as there are rows."""
    stage = Stage(docs.sparkSession, "imatch")
    vocab = stage.put(vocabulary(docs.withColumn("__id", F.lit(0)), "__id", text_col))
    return vocab.where(F.col("df") >= min_df).join(F.broadcast(over(docs, vocab, text_col, stage, max_share)), "h", "left_anti").select("h")


def in_order(docs: DataFrame, id_col: str, text_col: str, rare: DataFrame) -> DataFrame:
    """``(b, rn, t, s, id, next_b, next_rn, next_t, next_s)``: each document with the next in descending id, after the last the first.

    Null ids come last; equal ids in order of their texts. Documents are dealt to buckets of neighbouring ids, so there is
    no global sort: only the first document of each bucket crosses to the bucket above. Ids that crowd in a small part of
    their range make large buckets, which spill but stay right. ``rare`` has ``(id, k, s)``, a row before that of its document.
    """
    lo, hi, n = docs.agg(F.min(id_col), F.max(id_col), F.count("*")).first()
    lo, hi = (0, 0) if lo is None else (int(lo), int(hi))
    width = float(max(1, -(-(hi - lo + 1) // max(1, n // NEIGHBOURS))))
    bucket = F.coalesce(F.floor((F.col("id").cast("double") - F.lit(float(lo))) / F.lit(width)).cast("bigint"), F.lit(-1))
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t")).select("id", F.xxhash64("t").alias("k"), F.lit(1).alias("doc"), "t", F.lit(None).cast("array<bigint>").alias("s"), bucket.alias("b"))
    own = rare.select("id", "k", F.lit(0).alias("doc"), F.lit(None).cast("string").alias("t"), "s", bucket.alias("b"))
    w = Window.partitionBy("b").orderBy(F.col("id").desc_nulls_last(), "k", "doc", F.col("t"))
    follows = F.lead("doc").over(w) == 1
    ranked = src.unionByName(own).select(
        "b", "id", "doc", "t",
        F.sum("doc").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int").alias("rn"),
        F.when(F.lag("doc").over(w) == 0, F.lag("s").over(w)).alias("s"),
        F.when(follows, F.lead("t").over(w)).otherwise(F.lead("t", 2).over(w)).alias("lead_t"),
        F.when(~follows, F.lead("s").over(w)).alias("lead_s"),
    ).where("doc = 1")
    order = Window.orderBy(F.col("b").desc())  # bucket numbers alone, one for each few hundred documents
    used = src.select("b").distinct().select("b", F.lead("b").over(order).alias("below"), F.first("b").over(order).alias("top"))
    heads = src.withColumn("first", F.row_number().over(w)).where("first = 1").select(F.col("b").alias("head_b"), F.col("id").alias("head_id"), F.col("k").alias("head_k"), F.col("t").alias("head_t"))
    heads = heads.join(own.select("b", "id", "k", F.col("s").alias("head_s")), (F.col("head_b") == F.col("b")) & (F.col("head_k") == F.col("k")) & F.col("head_id").eqNullSafe(F.col("id")), "left").drop("b", "id", "k")
    after = used.select("b", F.coalesce("below", "top").alias("head_b")).join(heads, "head_b").select(F.col("b").alias("of"), "head_b", "head_t", "head_s")
    last = F.col("lead_t").isNull()
    return ranked.join(after, F.col("b") == F.col("of")).select(
        "b", "rn", "id", "t", "s",
        F.when(last, F.col("head_b")).otherwise(F.col("b")).alias("next_b"),
        F.when(last, F.lit(1)).otherwise(F.col("rn") + 1).alias("next_rn"),
        F.when(last, F.col("head_t")).otherwise(F.col("lead_t")).alias("next_t"),
        F.when(last, F.col("head_s")).otherwise(F.col("lead_s")).alias("next_s"),
    )


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they and the next document's are.

    ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, a row for every document. The
    last third of the code points is replaced by as many from the start of the next document in descending id. Null texts are
    empty; a document without a word is like another only if their texts are equal (1, else 0); equal
    texts are always 1. Equal ids stay separate documents. A single document is its own next. Empty tables give no rows. Texts of
    any length are read whole; other columns of ``docs`` are not read, whatever their names.
    """
    stage = Stage(docs.sparkSession, "imatch")
    none = F.array().cast("array<bigint>")
    vocab = stage.put(vocabulary(docs, id_col, text_col))
    common = over(docs, vocab, text_col, stage).agg(F.collect_list("h").alias("common"))
    rare = vocab.where("df = 1").groupBy("id", "k").agg(F.collect_list("h").alias("s"))
    n = F.length("t")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), n - third), F.substring("next_t", F.lit(1), third))
    rows = in_order(docs, id_col, text_col, rare).crossJoin(F.broadcast(common))  # a single row
    rows = rows.select("b", "rn", "id", "next_b", "next_rn", "t", "next_t", "common", F.coalesce("s", none).alias("s"), F.coalesce("next_s", none).alias("next_s"), edited.alias("e"))
    rows = held(rows, ot=terms(F.col("t")), et=terms(F.col("e")), nt=terms(F.col("next_t")))
    rows = held(rows, cut=F.array_except("et", F.concat("common", "ot", "nt")))  # words that only the cut makes: two at most
    rows = held(rows, own=F.array_except("ot", F.concat("common", "s")), edit=F.array_except("et", F.concat("common", "s", "next_s", "cut")), obits=bits_for(F.size("ot")), ebits=bits_for(F.size("et")))
    rows = held(rows, obare=F.size("own") == 0, ebare=F.size("edit") == 0, few=F.size("et") < FEW, oshift=63 - F.col("obits"), eshift=63 - F.col("ebits"))
    rows = held(rows, oall=sorted_terms(or_else(F.col("own"), F.col("ot"), F.col("s"))), eall=sorted_terms(or_else(F.col("edit"), F.col("et"), F.concat("s", "next_s", "cut"))))
    picked = stage.put(
        rows.select("b", "rn", "id", "next_b", "next_rn", n.cast("bigint").alias("n_chars"), F.xxhash64("t").alias("hash"), F.xxhash64("next_t").alias("next_hash"), F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), F.xxhash64("e").alias("edited_hash"),
                    "obits", "ebits", "cut", "obare", "ebare", "few", slots(F.col("oall"), F.col("oshift")).alias("os"), slots(F.col("eall"), F.col("eshift")).alias("es"))
    )
    # a document's next is nobody else's next, so that one partitioning by it serves both joins
    step = ["next_b", "next_rn"]
    made = picked.select(*step, F.explode("cut").alias("h")).join(vocab.where(F.col("df") >= MIN_DF).select("h"), "h").groupBy(*step).agg(F.collect_list("h").alias("more"))
    own = picked.drop("b", "rn", "cut").join(made, step, "left").withColumn("more", F.coalesce("more", none))
    only = F.col("ebare") & (F.size("more") > 0)  # then these are all it has in the band
    ints = F.array().cast("array<int>")
    own = own.withColumn("es", F.when(F.col("few"), F.col("es")).otherwise(with_terms(F.when(only, ints).otherwise(F.col("es")), F.col("ebits"), F.col("more")))).withColumn("ebare", F.col("ebare") & ~only)
    after = picked.select(F.col("b").alias("next_b"), F.col("rn").alias("next_rn"), F.col("obits").alias("nbits"), F.col("os").alias("ns"))
    both = held(own.join(after, step, "left"), e_like=likeness(F.col("obits"), F.col("os"), F.col("ebits"), F.col("es")), n_like=likeness(F.col("obits"), F.col("os"), F.col("nbits"), F.col("ns")))
    like = lambda same, found: F.when(same, F.lit(1.0)).otherwise(F.coalesce(found, F.lit(0.0)))
    return both.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        written(F.col("obits"), F.col("os"), F.col("hash"), F.col("obare")).alias("fingerprint"),
        written(F.col("ebits"), F.col("es"), F.col("edited_hash"), F.col("ebare")).alias("edited_fingerprint"),
        like(F.col("hash") == F.col("edited_hash"), F.col("e_like")).alias("near_edited"),
        like(F.col("hash") == F.col("next_hash"), F.col("n_like")).alias("near_next"),
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, bits, slots, fingerprint)`` of each document, a row for every row: ``likeness`` compares two of them by bits and slots.

    ``slots`` is null where there is no word (null and empty texts, and those of signs alone); then the fingerprint is of the whole
    text. Rows of equal id and text have equal fingerprints and are worked on once; null ids stay. A text may be of any length. An
    empty table gives no rows; other columns of ``docs``, whatever their names, are not read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t")).select("id", F.xxhash64("t").alias("hash"), terms(F.col("t")).alias("all"))
    src = src.withColumn("bits", bits_for(F.size("all")))
    stage = Stage(docs.sparkSession, "imatch")
    vocab = stage.put(vocabulary(docs, id_col, text_col))
    inside = vocab.select("h", "df").join(F.broadcast(over(docs, vocab, text_col, stage).withColumn("over", F.lit(True))), "h", "left")
    asked = src.select("hash", "bits", F.explode("all").alias("h")).distinct().join(inside, "h")
    shared = F.col("df") >= MIN_DF
    kept = asked.groupBy("hash", "bits").agg(F.collect_list(F.when(shared & F.col("over").isNull(), F.col("h"))).alias("own"), F.collect_list("h").alias("every"), F.collect_list(F.when(~shared, F.col("h"))).alias("lone"))
    kept = held(kept, bare=F.size("own") == 0, kept=sorted_terms(or_else(F.col("own"), F.col("every"), F.col("lone"))))
    made = kept.select("hash", "bare", slots(F.col("kept"), 63 - F.col("bits")).alias("slots"))
    return src.select("id", "hash", "bits").join(made, "hash", "left").select(F.col("id").alias(id_col), "bits", "slots", written(F.col("bits"), F.col("slots"), F.col("hash"), F.col("bare")).alias("fingerprint"))
