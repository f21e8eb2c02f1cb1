"""Sentence, word and date differences of matched sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausediff.functions.sentences import sentences
from clausediff.functions.temporal import temporal_expressions
from clausediff.functions.text import compare_key, starts, words
from clausediff.operators.align import opcodes, ratio
from clausediff.schema import MIN_SENTENCE_RATIO


def _range(a: Column, b: Column) -> Column:
    return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))


def steps(codes: Column) -> Column:
    """Opcodes as an array of (op, i, j): pairs of a replaced block by position, then its surplus."""

    def one(c: Column) -> Column:
        a, b = c["i2"] - c["i1"], c["j2"] - c["j1"]
        paired = F.when(c["op"].isin("equal", "replace"), F.least(a, b)).otherwise(0)
        row = lambda op, i, j: F.struct(op.alias("op"), i.cast("int").alias("i"), j.cast("int").alias("j"))
        none = F.lit(None)
        return F.concat(
            F.transform(_range(F.lit(0), paired), lambda k: row(c["op"], c["i1"] + k, c["j1"] + k)),
            F.transform(_range(c["i1"] + paired, c["i2"]), lambda i: row(F.lit("delete"), i, none)),
            F.transform(_range(c["j1"] + paired, c["j2"]), lambda j: row(F.lit("insert"), none, j)),
        )

    return F.flatten(F.transform(codes, one))


def section_sentences(units: Column, body: Column) -> Column:
    """Array of (text, fragments): sentences of the joined body, each with the pieces of units that it covers, so a page's end cuts none."""
    begins = F.slice(starts(F.transform(units, lambda u: u["text"]), 1), 1, F.size(units))
    bounds = F.zip_with(units, begins, lambda u, a: F.struct(u.alias("u"), a.alias("a"), (a + F.length(u["text"])).alias("b")))

    def fragments(s: Column, bounds: Column) -> Column:
        met = F.filter(bounds, lambda x: F.greatest(s["start"], x["a"]) < F.least(s["end"], x["b"]))

        def piece(x: Column) -> Column:
            lo, hi = F.greatest(s["start"], x["a"]), F.least(s["end"], x["b"])
            return F.struct(
                x["u"]["page_no"].alias("page_no"), x["u"]["block_index"].alias("block_index"),
                (x["u"]["char_start"] + lo - x["a"]).alias("char_start"), (x["u"]["char_start"] + hi - x["a"]).alias("char_end"),
                F.substring(x["u"]["text"], lo - x["a"] + 1, hi - lo).alias("text"),
            )

        return F.transform(met, piece)

    # the bounds are made once, not for each sentence
    return F.transform(F.array(bounds), lambda own: F.transform(sentences(body), lambda s: F.struct(s["text"].alias("text"), fragments(s, own).alias("fragments"))))[0]


def pair_sections(sections: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches with both sections as structs ``old`` and ``new``."""
    whole = lambda side: sections.where(F.col("side") == side).select("pair_id", F.col("order_index").alias(f"{side}_index"), F.struct(*(c for c in sections.columns if c not in ("pair_id", "side"))).alias(side))
    return matches.join(whole("old"), ["pair_id", "old_index"]).join(whole("new"), ["pair_id", "new_index"])


def sentence_diffs(pairs: DataFrame) -> DataFrame:
    """(pair_id, old_index, new_index, diff_no, op, old, new): the steps from the old section's sentences to the new one's.

    ``old`` and ``new`` are (text, fragments). Sections with equal bodies are
    never aligned in Python.
    """
    cut = pairs.select("pair_id", "old_index", "new_index", section_sentences(F.col("old.units"), F.col("old.body")).alias("os"), section_sentences(F.col("new.units"), F.col("new.body")).alias("ns"))
    keys = cut.select("*", F.transform("os", lambda s: compare_key(s["text"])).alias("ok"), F.transform("ns", lambda s: compare_key(s["text"])).alias("nk"))
    aligned = keys.select("pair_id", "old_index", "new_index", "os", "ns", F.posexplode(steps(opcodes(F.col("ok"), F.col("nk")))).alias("diff_no", "s"))
    return aligned.select("pair_id", "old_index", "new_index", "diff_no", F.col("s.op").alias("op"), F.get("os", F.col("s.i")).alias("old"), F.get("ns", F.col("s.j")).alias("new"))


def word_diffs(diffs: DataFrame) -> DataFrame:
    """``diffs`` with word_diffs, array of (op, old_words, new_words), of replaced sentences; null for others."""
    replaced = F.col("op") == "replace"
    split = diffs.select("*", F.when(replaced, words(F.col("old.text"))).alias("ow"), F.when(replaced, words(F.col("new.text"))).alias("nw"))
    cut = lambda arr, a, b: F.slice(arr, a + 1, b - a)
    made = F.transform(
        opcodes(F.col("ow"), F.col("nw")),
        lambda c: F.struct(c["op"].alias("op"), cut(F.col("ow"), c["i1"], c["i2"]).alias("old_words"), cut(F.col("nw"), c["j1"], c["j2"]).alias("new_words")),
    )
    return split.select(*diffs.columns, F.when(replaced, made).alias("word_diffs"))


def temporal_changes(diffs: DataFrame) -> DataFrame:
    """(pair_id, old_index, new_index, diff_no, change_no, old, new, page_no): changed dates and durations of matched sections.

    ``old`` and ``new`` are (kind, text, value), either null where nothing is
    paired. Expressions of a replaced sentence are paired only if its words
    are similar enough; else the old ones were removed and the new ones added.
    """
    changed = diffs.where("op <> 'equal'").select("*", temporal_expressions(F.col("old.text")).alias("oe"), temporal_expressions(F.col("new.text")).alias("ne"))
    none = F.array().cast("array<struct<kind:string,text:string,value:string>>")
    changed = changed.select("pair_id", "old_index", "new_index", "diff_no", "op", "old", "new", F.coalesce("oe", none).alias("oe"), F.coalesce("ne", none).alias("ne"))
    key = lambda e: F.transform(e, lambda x: F.concat_ws(" ", x["kind"], x["value"]))
    changed = changed.select("*", key(F.col("oe")).alias("ok"), key(F.col("ne")).alias("nk")).where("ok <> nk")
    paired = F.col("op") == "replace"
    near = ratio(F.when(paired, words(F.col("old.text"))), F.when(paired, words(F.col("new.text")))) >= MIN_SENTENCE_RATIO
    changed = changed.withColumn("near", paired & near)
    apart = F.concat(
        F.transform("oe", lambda e, i: F.struct(F.lit("delete").alias("op"), i.cast("int").alias("i"), F.lit(None).cast("int").alias("j"))),
        F.transform("ne", lambda e, j: F.struct(F.lit("insert").alias("op"), F.lit(None).cast("int").alias("i"), j.cast("int").alias("j"))),
    )
    lined = F.filter(steps(opcodes(F.when(F.col("near"), F.col("ok")), F.when(F.col("near"), F.col("nk")))), lambda s: s["op"] != "equal")
    rows = changed.select("*", F.posexplode(F.when(F.col("near"), lined).otherwise(apart)).alias("change_no", "s"))
    page = lambda c: F.try_element_at(F.filter(F.transform(c, lambda f: f["page_no"]), lambda p: p.isNotNull()), F.lit(1))
    rows = rows.select("pair_id", "old_index", "new_index", "diff_no", "change_no", F.get("oe", F.col("s.i")).alias("old"), F.get("ne", F.col("s.j")).alias("new"), page(F.col("old.fragments")).alias("p1"), page(F.col("new.fragments")).alias("p2"))
    return rows.select("pair_id", "old_index", "new_index", "diff_no", "change_no", "old", "new", F.coalesce(F.when(F.col("old").isNotNull(), F.col("p1")), F.when(F.col("new").isNotNull(), F.col("p2"))).alias("page_no"))


def sentence_keys(body: Column) -> Column:
    """The keys by which a body's sentences are compared: two bodies have a sentence that differs just if these differ."""
    return F.transform(sentences(body), lambda s: compare_key(s["text"]))


def section_ratio(pairs: DataFrame) -> DataFrame:
    """``pairs`` with similarity: the ratio of their bodies' normalised words."""
    key = lambda c: words(compare_key(F.col(c)))
    return pairs.select("*", ratio(key("old.body"), key("new.body")).alias("similarity"))
