from __future__ import annotations

import datetime
import random
import re
from pathlib import PurePosixPath

import pytest
from helpers import one
from pyspark.sql import functions as F

from clausediff.functions import temporal, text
from clausediff.functions.sentences import sentences
from clausediff.schema import ABBREVIATIONS, MONTHS, QUOTES_AND_DASHES


def plain_key(value: str) -> tuple[str, list[int]]:
    out = []
    dropped = {i for m in re.finditer(r"(?<=[^\W\d_])-\n(?=[^\W\d_])", value) for i in range(m.start(), m.end())}
    for i, ch in enumerate(value):
        if i in dropped or ch.isspace() and i and value[i - 1].isspace() and i - 1 not in dropped:
            continue
        out.append((" " if ch.isspace() else QUOTES_AND_DASHES.get(ch, ch), i))
    return "".join(c for c, _ in out), [i for _, i in out]


def test_key_and_positions_of_random_texts(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice("ab-\n  “’—çİ.1") for _ in range(rng.randrange(0, 18))) for _ in range(400)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", text.compare_key(F.col("t")).alias("k"), text.key_positions(F.col("t")).alias("p")).collect()
    for r in rows:
        assert (r.k, r.p) == plain_key(values[r.i]), values[r.i]


def test_span_of_a_key_maps_back(spark):
    t = "ge-\nlir  “x”"
    span = lambda a, b: tuple(one(spark, text.map_span(text.key_positions(F.col("t")), F.col("t"), F.lit(a), F.lit(b)), t=t))
    assert span(0, 5) == (0, 7)
    assert span(6, 9) == (9, 12)
    assert span(99, 99) == (len(t), len(t))
    assert span(2, 2) == (4, 4)


def test_title_key_is_not_turkish(spark):
    key = lambda t: one(spark, text.title_key(F.col("t")), t=t)
    assert key("  Amaç   ve\nKapsam ") == "amaç ve kapsam"
    assert key("KISMI") != key("kısmı")
    assert key("İŞLER") == "İŞLER".casefold()
    assert key("Straße") == "strasse"


@pytest.mark.parametrize(("value", "safe"), [("=1", "'=1"), ("+x", "'+x"), ("-", "'-"), ("@a", "'@a"), ("a=1", "a=1"), ("", "")])
def test_formula_guard(spark, value, safe):
    assert one(spark, text.neutral_formula(F.col("t")), t=value) == safe


def test_escape_repetition_and_labels(spark):
    assert one(spark, text.escape(F.col("t")), t="<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"
    assert one(spark, text.repetition_key(F.col("t")), t="  Sayfa  12 / 340 ") == "Sayfa # / #"
    path = F.array(F.lit("BİRİNCİ KISIM"), F.lit("İKİNCİ BÖLÜM"), F.lit("MADDE 3"))
    assert one(spark, text.section_label(path), t="") == "BİRİNCİ KISIM > İKİNCİ BÖLÜM"
    assert one(spark, text.section_bucket(F.array(F.lit("MADDE 1"))), t="") == "(Bölüm Bilgisi Yok)"
    assert one(spark, text.article_label(F.lit(""), path), t="") == "MADDE 3"
    assert one(spark, text.article_label(F.lit(None).cast("string"), F.array().cast("array<string>")), t="") == "(başlıksız madde)"


def plain_sentences(value: str) -> list[tuple[int, int, str]]:
    cuts = []
    for m in re.finditer(r"[.!?]+", value):
        before, after = value[: m.start()], value[m.end() :]
        token = re.search(r"\S*$", before)[0] + m[0]
        if before[-1:].isdigit() and after[:1].isdigit() or token in ABBREVIATIONS or re.fullmatch(r"[A-ZÇĞİÖŞÜ]\.", token) or after.lstrip()[:1].islower():
            continue
        cuts.append(m.end())
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(value)], strict=True):
        part = value[a:b]
        if part.strip():
            start = a + len(part) - len(part.lstrip())
            out.append((start, start + len(part.strip()), part.strip()))
    return out


def test_sentences_of_random_texts(spark):
    rng = random.Random(2)
    pieces = ["Dr.", "T.C.", "vb.", "14.11.2019", "Madde 5.", "A.", "son", "Son", "!", "?!", "...", ". ", " ", "\n", "ığ", "Ş", "s.", "3"]
    values = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 9))) for _ in range(600)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", sentences(F.col("t")).alias("s")).collect()
    for r in rows:
        assert [tuple(s) for s in r.s] == plain_sentences(values[r.i]), repr(values[r.i])


@pytest.mark.parametrize(
    ("value", "found"),
    [
        ("14.11.2019 ve 14/11/2019", ["2019-11-14", "2019-11-14"]),
        ("14 Kasım 2019 günü", ["2019-11-14"]),
        ("2020 yılında, 2021 yılının", ["2020-YIL", "2021-YIL"]),
        ("32.13.2019 ve 31.2.2020", []),
        ("30 gün, 6 ay", ["30 gün", "6 ay"]),
        ("üç bin yüz on iki gün", ["3112 gün"]),
        ("kırk beş hafta ile bin yıl", ["45 hafta", "1000 yıl"]),
        ("30 günlük 30 iş günü", []),
        ("007 gün", ["007 gün"]),
        ("1.000 gün", ["000 gün"]),
        ("5 Gün", []),
        ("01.01.0000", []),
    ],
)
def test_temporal_expressions(spark, value, found):
    got = one(spark, temporal.temporal_expressions(F.col("t")), t=value)
    assert [e.value for e in got] == found
    assert all(e.text in value for e in got)


def test_months_are_numbered(spark):
    for name, number in MONTHS.items():
        assert one(spark, temporal.temporal_expressions(F.col("t")), t=f"1 {name} 2020")[0].value == f"2020-{number:02d}-01"


@pytest.mark.parametrize(
    ("name", "day"),
    [
        ("yonetmelik_14.11.2019.pdf", (2019, 11, 14)), ("a-2019-11-14.docx", (2019, 11, 14)), ("x_2019.pdf", (2019, 1, 1)),
        ("31.02.2020_2021-03-04.pdf", (2021, 3, 4)), ("x.pdf", None), ("120190.pdf", None),
    ],
)
def test_filename_dates(spark, name, day):
    assert one(spark, temporal.filename_date(F.col("t")), t=name) == (day and datetime.date(*day))


def test_metadata_comes_before_the_file_name(spark):
    path = F.lit("/in/2001/x_2019.pdf")
    assert tuple(one(spark, temporal.suggested_date(path, F.col("t")), t="D:20180203101010")) == (datetime.date(2018, 2, 3), "metadata")
    assert tuple(one(spark, temporal.suggested_date(path, F.col("t")), t="2018-02-03T10:00")) == (datetime.date(2018, 2, 3), "metadata")
    assert tuple(one(spark, temporal.suggested_date(path, F.col("t")), t="D:20181399")) == (datetime.date(2019, 1, 1), "filename")
    assert tuple(one(spark, temporal.suggested_date(F.lit("x.pdf"), F.col("t")), t=None)) == (None, "none")


def test_names_and_citations(spark):
    none, day = F.lit(None).cast("date"), F.make_date(F.lit(2019), F.lit(11), F.lit(14))
    name = lambda slot, label, e, p: one(spark, temporal.display_name(F.lit(slot), F.lit(label), e, p, F.col("t")), t="/in/a.pdf")
    assert name("A", "2019 sürümü", day, none) == "Belge A (2019 sürümü)"
    assert name("B", None, none, day) == "Belge B (14.11.2019)"
    assert name(None, "", none, none) == f"Belge ({PurePosixPath('/in/a.pdf').name})"
    assert one(spark, temporal.citation(F.lit("Belge B"), F.lit("MADDE 5"), F.lit(3)), t="") == "Belge B, MADDE 5, s. 3"
    assert one(spark, temporal.citation(F.lit("Belge B"), F.lit("MADDE 5"), F.lit(None).cast("int")), t="") == "Belge B, MADDE 5"
