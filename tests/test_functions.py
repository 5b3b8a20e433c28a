"""Hand-computed values of the scalar functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import hashing, stats, text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_two_proportion_z(spark):
    lit = F.lit
    got = one(
        spark,
        up=stats.two_proportion_z(lit(5), lit(100), lit(25), lit(100)),
        down=stats.two_proportion_z(lit(25), lit(100), lit(5), lit(100)),
        scored=stats.two_proportion_z(lit(50), lit(1000), lit(30), lit(200)),
        empty=stats.two_proportion_z(lit(0), lit(0), lit(3), lit(10)),
        none=stats.two_proportion_z(lit(0), lit(10), lit(0), lit(10)),
        every=stats.two_proportion_z(lit(10), lit(10), lit(10), lit(10)),
    )
    assert got["up"] == pytest.approx(3.96059, abs=1e-5) and got["down"] == pytest.approx(-3.96059, abs=1e-5)
    assert got["scored"] == pytest.approx(5.175492, abs=1e-6)
    assert got["empty"] == got["none"] == got["every"] == 0.0


def test_score_and_severity(spark):
    got = one(
        spark,
        score=stats.anomaly_score(F.lit(5.175492), F.lit(0.1)),
        negative=stats.anomaly_score(F.lit(-2.0), F.lit(0.1)),
        **{f"s{i}": stats.severity(F.lit(x)) for i, x in enumerate((12.0, 7.0, 5.0, 3.2, 1.0))},
        confidence=stats.confidence(F.lit(0.7403), F.lit(0.64)),
    )
    assert got["score"] == pytest.approx(3.450328, abs=1e-6) and got["negative"] == 0.0
    assert [got[f"s{i}"] for i in range(5)] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE"]
    assert round(got["confidence"], 4) == 0.6883


def test_hash_lanes(spark):
    d = F.sha2(F.lit("TXN1|key"), 256)
    got = one(spark, **{f"u{i}": hashing.lane_uniform(d, i) for i in range(4)})
    assert [got[f"u{i}"] for i in range(4)] == [0.9534318161274246, 0.22042170972260294, 0.9849516568543067, 0.9734549175500851]


def test_digest_is_plain_sha256(spark):
    got = one(spark, d=hashing.digest("a", F.lit("b")))["d"]
    assert got == hashlib.sha256(b"a|b").hexdigest()


def test_weighted_choice_guard(spark):
    options = [("a", F.lit(0.2)), ("b", F.lit(0.5)), ("c", F.lit(0.3))]
    got = one(spark, **{f"c{i}": hashing.weighted_choice(F.lit(u), options) for i, u in enumerate((0.0, 0.19, 0.2, 0.69, 0.71, 1.0))})
    assert [got[f"c{i}"] for i in range(6)] == ["a", "a", "b", "b", "c", "c"]


def test_cleaning(spark):
    got = one(
        spark,
        nbsp=text.clean_text(F.lit("\u00a0 P2P\u2003\t")),
        blank=text.clean_text(F.lit("   ")),
        half=text.money(F.lit("1.005")),
        odd=text.money(F.lit("1.015")),
        nan=text.money(F.lit("NaN")),
        inf=text.money(F.lit("Infinity")),
        unpadded=text.local_time(F.lit("2024-6-5 1:2:3")),
        nonsense=text.local_time(F.lit("2024-02-30 10:00:00")),
        yes=text.flag(F.lit(" YES ")),
        no=text.flag(F.lit("0")),
        maybe=text.flag(F.lit("maybe")),
        grouped=text.grouped_number(F.lit("1,07,801\u00a0")),
        month=text.short_month(F.lit("16-Apr")),
        total=text.short_month(F.lit("Total")),
        bank=text.institution(F.lit("Axis  Bank Ltd.")),
    )
    assert got["nbsp"] == "P2P" and got["blank"] is None
    assert str(got["half"]) == "1.00" and str(got["odd"]) == "1.02"
    assert got["nan"] is None and got["inf"] is None and got["nonsense"] is None and got["maybe"] is None and got["total"] is None
    assert str(got["unpadded"]) == "2024-06-04 19:32:03"
    assert got["yes"] is True and got["no"] is False
    assert got["grouped"] == 107801.0 and str(got["month"]) == "2016-04-01" and got["bank"] == "AXIS BANK"
