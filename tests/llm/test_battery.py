"""The randomness battery of the secret scan against plain statistics, and its calibration under prose."""

import math
import random

from pyspark.sql import functions as F

from tessera.llm import secrets as S

ALPHABETS = {
    "hex": "0123456789ABCDEF", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower": "abcdefghijklmnopqrstuvwxyz", "alnum": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def tail(z):
    return max(1e-300, math.erfc(z / math.sqrt(2)) / 2)


def plain(tok, abc):
    v = [abc.index(c) for c in tok.rstrip("=").translate(str.maketrans("-_", "+/"))]
    n, m = len(v), len(abc)
    chi = sum(v.count(x) ** 2 for x in set(v)) / (n / m) - n
    z1 = ((chi / (m - 1)) ** (1 / 3) - (1 - 2 / (9 * (m - 1)))) / math.sqrt(2 / (9 * (m - 1)))
    hi = [x >= m / 2 for x in v]
    runs, n1 = 1 + sum(a != b for a, b in zip(hi, hi[1:], strict=False)), sum(hi)
    mean = 2 * n1 * (n - n1) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z2 = abs((runs - mean) / math.sqrt(var)) if var > 0 else 9.0
    mid = sum(v) / n
    ss = sum((x - mid) ** 2 for x in v)
    z3 = abs(sum((a - mid) * (b - mid) for a, b in zip(v, v[1:], strict=False)) / ss * math.sqrt(n)) if ss else 9.0
    s = max(0.0, -math.log(tail(z1)) - math.log(2 * tail(z2)) - math.log(2 * tail(z3)))
    return math.exp(-s) * (1 + s + s * s / 2)


def test_battery(spark):
    rng = random.Random(6)
    toks = {}
    for name, abc in ALPHABETS.items():
        for n in (40, 64, 150):
            toks["".join(rng.choice(abc) for _ in range(n))] = abc
        toks["".join(abc[k % 5] for k in range(50)) + abc[-1] + abc[len(abc) // 2]] = abc
    toks |= {"Ab1" * 14: ALPHABETS["base64"], "Zz9-_" * 9 + "==": ALPHABETS["base64"]}
    for r in S.random_p(spark.createDataFrame([(t,) for t in toks], "tok string"), "tok").collect():
        abc = toks[r["tok"]]
        if r["letters"] == len(abc):  # a text may lie in a smaller alphabet
            assert math.isclose(r["random_p"], plain(r["tok"], abc), rel_tol=1e-3, abs_tol=1e-7), r
    assert S.random_p(spark.createDataFrame([("=" * 30,)], "tok string"), "tok").count() == 0


def test_calibration_under_prose(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice([1.0, 1.0, 10 ** -rng.uniform(0, 30)]), 10 ** -rng.uniform(0, 12), rng.choice([26, 64]), rng.choice([4, 5])) for k in range(600)]
    df = spark.createDataFrame(rows, "row long, prose double, random_p double, letters int, lengths int")
    bin_ = lambda p: math.floor(-4 * math.log(p))
    for r in S.combined_p(df).collect():
        nulls = [bin_(x[2]) for x in rows if x[1] >= 1 and x[3:] == (r["letters"], r["lengths"])]
        battery = (1 + sum(b <= bin_(r["random_p"]) for b in nulls)) / (1 + len(nulls))
        assert math.isclose(r["p"], min(1.0, 2 / (1 / r["prose"] + 0.5 / math.sqrt(battery))), rel_tol=1e-9)


def test_few_runs_of_prose_are_reported(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("etaoinshrdlu", weights=range(12, 0, -1), k=rng.randint(2, 8))) for _ in range(400)]
    prose = [(k, "-".join(rng.choice(words) for _ in range(6))) for k in range(1_500)]
    secret = [(10_000 + k, "".join(rng.choice(ALPHABETS["base64"]) for _ in range(44))) for k in range(100)]
    got = [r["doc_id"] for r in S.find_secrets(spark.createDataFrame(prose + secret, "doc_id long, text string")).where(F.size("extra") > 0).collect()]
    found = sum(i >= 10_000 for i in got)
    assert found >= 90 and len(got) - found <= 2
