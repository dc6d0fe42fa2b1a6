"""Secrets in texts: three patterns, and a randomness test battery for what no pattern names. DataFrame functions only.

Base spans are leftmost non-overlapping matches of each kind (assign, access, hex) that reach their least length.
Positions come from the lengths of the pieces between matches, so they are code points.

The battery looks at every run of 20 or more characters of ``[A-Za-z0-9+/_=-]``, and where base spans overlap one, at
what they leave of it to either side (so never at digits or lower-case hex alone, which are base spans):

* the encoding is inferred (hex, base32, letters of one case, with digits or without, base64) and gives the alphabet;
* against randomness, uniformity over that alphabet (chi-squared), runs above and below the alphabet's middle, and lag-1
  serial correlation give three p-values, combined by Fisher's method; below ``ALPHA`` a run is not random;
* against prose, so do uniformity and runs. Letters: their likelihood in prose of the likeliest language over that of
  uniform letters of the encoding. Runs of lower case, upper case, digits and signs: the likelihood of so many changes
  if a change has odds of ``CHANGES`` at most, over that at the odds that encodings have. The product of both ratios
  is by Markov's inequality a p-value under prose, whatever the length;
* the battery's own p-value under prose is calibrated on the table: how many of the runs that letters and changes call
  prose look as random, of the same alphabet and class of lengths. The two p-values depend on each other, so they are
  combined as bets: the mean of 1 / p of the one and of 1 / (2 * sqrt(p)) of the other is one that prose wins, on average,
  at most once over, so its inverse is a p-value;
* Benjamini-Hochberg at ``FDR`` on these p-values, within each class of lengths (powers of two), decides over all runs of
  the table, so of long and short runs alike few that are reported are prose.

Null and empty texts have no spans. Very long texts are scanned whole. Repeated rows get a result each; runs of equal p
are reported together or not at all. An empty table gives no rows, and other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: kind, pattern, group whose length counts, least length, a cheap pattern that every text with such a match has
KINDS = (
    ("assign", ASSIGN, 2, 12, ASSIGN[:-2] + "{12})"),
    ("access", ACCESS, 0, 18, r"AKIA[A-Z0-9]{14}"),
    ("hex", HEX, 0, 16, r"[0-9a-f]{16}"),
)
SIGN = "A-Za-z0-9+/_=-"
LEAST = 20
CHANGES, ALPHA, FDR = 0.1, 0.001, 0.01
RATES = (0.3, 0.45, 0.6)  # odds of a change in base32, in digits and letters of one case, in base64
PART = 256  # spans that are appended to one by one
#: Per mille of the letters a to z in prose: English, German, French, Spanish, Italian (at least 1 each).
LETTERS = (
    (82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 7.7, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 9.8, 24, 1.5, 20, 1),
    (65, 19, 27, 51, 164, 17, 30, 46, 66, 2.7, 14, 34, 25, 98, 26, 7, 1, 70, 73, 62, 42, 8, 19, 1, 1, 11),
    (76, 9, 33, 37, 147, 11, 9, 7, 75, 6, 1, 55, 30, 71, 58, 25, 14, 67, 79, 72, 63, 18, 1, 4, 1.3, 3),
    (115, 22, 40, 50, 122, 7, 18, 7, 62, 5, 1, 50, 32, 67, 87, 25, 9, 69, 80, 46, 29, 11, 1, 2, 10, 4.7),
    (117, 9, 45, 37, 118, 11, 16, 6, 101, 1, 1, 65, 25, 69, 98, 30, 5, 64, 50, 56, 30, 21, 1, 1, 1, 12),
)
SPAN = "array<struct<start:bigint,end:bigint,tok:string>>"


def _matches(text: Column, pattern: str, group: int, least: int, hint: str) -> Column:
    """[(start, end, match)] of the matches whose group has at least `least` characters."""
    p = F.lit(pattern)
    pieces, whole, part = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    rows = F.arrays_zip(pieces, whole, part)
    none = F.expr(f"cast(array() as {SPAN})")
    nones = F.expr(f"cast(array() as array<{SPAN}>)")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"), nones.alias("done"))

    def step(acc, x):
        """Spans go to parts of PART, so that an append copies a part and not all there are."""
        begin = acc["at"] + F.coalesce(F.length(x["0"]), F.lit(0))
        end = begin + F.coalesce(F.length(x["1"]), F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), x["1"].alias("tok"))
        ok, full = x["1"].isNotNull() & (F.length(x["2"]) >= least), F.size(acc["out"]) >= PART
        out = F.when(~ok, acc["out"]).when(full, F.array(span)).otherwise(F.concat(acc["out"], F.array(span)))
        done = F.when(ok & full, F.concat(acc["done"], F.array(acc["out"]))).otherwise(acc["done"])
        return F.struct(end.cast("long").alias("at"), out.cast(SPAN).alias("out"), done.cast(f"array<{SPAN}>").alias("done"))

    found = F.aggregate(rows, start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["out"]))).cast(SPAN))
    return F.when(text.rlike(hint), found).otherwise(none)


def _upper_tail(z: Column, t: Column) -> Column:
    """1 - Phi(z), by Zelen and Severo's polynomial in t = 1 / (1 + 0.2316419 * |z|)."""
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    p = poly * F.exp(-z * z / 2) * 0.3989422804014327
    return F.greatest(F.lit(1e-300), F.when(z >= 0, p).otherwise(1 - p))


def changes(tok: Column) -> Column:
    """Changes between lower case, upper case, digits and signs."""
    return F.regexp_count(tok, F.lit(r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[+/_=-](?=[^+/_=-])"))


def prose_p(tok: Column) -> Column:
    """Likelihood in prose over that in an encoding, of the changes and the letters; at most 1."""
    n, c = F.length(tok) - 1.0, changes(tok)
    q = F.least(c / n, F.lit(CHANGES))
    prose = F.when(c > 0, c * F.log(q)).otherwise(0.0) + (n - c) * F.log(1 - q)
    ratio = lambda r: F.exp(F.least(c * math.log(r) + (n - c) * math.log(1 - r) - prose, F.lit(600.0)))
    counts = F.array(*[F.regexp_count(tok, F.lit(f"[{x}{x.upper()}]")).cast("double") for x in "abcdefghijklmnopqrstuvwxyz"])
    odds = F.array(*[F.array(*[F.lit(math.log(26 * v / sum(own))) for v in own]) for own in LETTERS])
    letters = F.array_max(F.transform(odds, lambda w: F.aggregate(F.zip_with(counts, w, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)))
    hex_ = F.when(tok.rlike("^[0-9A-F]+$"), F.regexp_count(tok, F.lit("[A-F]")) * math.log(6 / 26)).otherwise(0.0)
    log_p = letters + hex_ - F.log((1 + sum(ratio(r) for r in RATES)) / (1 + len(RATES)))
    return F.exp(F.greatest(F.least(log_p, F.lit(0.0)), F.lit(-600.0)))


def _parts(run: Column, base: Column) -> Column:
    """The parts of a run that base spans leave, of at least LEAST characters."""
    cut = F.array_sort(F.transform(F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    start = F.struct(run["start"].cast("long").alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def piece(begin, end):
        return F.struct(begin.alias("start"), end.alias("end"), F.substring(run["tok"], (begin - run["start"] + 1).cast("int"), (end - begin).cast("int")).alias("tok"))

    def step(acc, b):
        more = F.when(b["start"] - acc["at"] >= LEAST, F.concat(acc["out"], F.array(piece(acc["at"], b["start"])))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], b["end"]).cast("long").alias("at"), more.cast(SPAN).alias("out"))

    def last(acc):
        return F.when(run["end"] - acc["at"] >= LEAST, F.concat(acc["out"], F.array(piece(acc["at"], run["end"])))).otherwise(acc["out"]).cast(SPAN)

    return F.aggregate(cut, start, step, last)


def _bind(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, computed once however often what follows names them (one generated row for each)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def random_p(df: DataFrame, tok: str) -> DataFrame:
    """df with random_p: Fisher's combination of uniformity, runs and serial correlation; and letters of the alphabet."""
    t = F.col(tok)
    alphabet = (
        F.when(t.rlike("^[0-9A-F]+$"), "0123456789ABCDEF")
        .when(t.rlike("^[A-Z]{33,}$"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")  # shorter ones may be base32 that has no digit
        .when(t.rlike("^[A-Z2-7]+=*$"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
        .when(t.rlike("^[a-z]+$"), "abcdefghijklmnopqrstuvwxyz")
        .when(t.rlike("^[a-z0-9]+$"), "abcdefghijklmnopqrstuvwxyz0123456789")
        .when(t.rlike("^[A-Z0-9]+$"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
        .otherwise("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    )
    x = _bind(_bind(df, _abc=alphabet), _m=F.length("_abc").cast("double"))
    plain = F.translate(F.regexp_replace(t, "=+$", ""), "-_", "+/")
    x = _bind(x, _v=F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(F.col("_abc"), c).cast("double") - 1))
    x = _bind(x, _n=F.size("_v").cast("double")).where("_n >= 8")  # less than that tells nothing
    x = _bind(x, _hi=F.transform("_v", lambda y: y >= F.col("_m") / 2), _mean=F.aggregate("_v", F.lit(0.0), lambda a, y: a + y) / F.col("_n"))
    expected = F.col("_n") / F.col("_m")
    chi = F.aggregate(F.array_distinct("_v"), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter("_v", lambda y: y == c)), F.lit(2.0))) / expected - F.col("_n")
    df_ = F.col("_m") - 1
    z1 = (F.pow(F.greatest(F.col("_chi"), F.lit(0.0)) / df_, F.lit(1 / 3)) - (1 - 2 / (9 * df_))) / F.sqrt(2 / (9 * df_))
    rest, lead = F.slice("_hi", 2, F.greatest(F.size("_hi") - 1, F.lit(1))), F.slice("_hi", 1, F.greatest(F.size("_hi") - 1, F.lit(1)))
    runs = 1.0 + F.size(F.filter(F.zip_with(lead, rest, lambda a, b: a != b), lambda b: b))
    n, n1, n2 = F.col("_n"), F.col("_n1"), F.col("_n") - F.col("_n1")
    mean = 2 * n1 * n2 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z2 = F.when(var > 0, (F.col("_runs") - mean) / F.sqrt(var)).otherwise(9.0)
    ss = F.aggregate("_v", F.lit(0.0), lambda a, y: a + (y - F.col("_mean")) * (y - F.col("_mean")))
    vlead, vrest = F.slice("_v", 1, F.greatest(F.size("_v") - 1, F.lit(1))), F.slice("_v", 2, F.greatest(F.size("_v") - 1, F.lit(1)))
    lag = F.aggregate(F.zip_with(vlead, vrest, lambda a, b: (a - F.col("_mean")) * (b - F.col("_mean"))), F.lit(0.0), lambda a, y: a + y)
    z3 = F.when(F.col("_ss") > 0, F.col("_lag") / F.col("_ss") * F.sqrt(n)).otherwise(9.0)
    x = _bind(x, _chi=chi, _runs=runs, _ss=ss, _lag=lag, _n1=F.size(F.filter("_hi", lambda b: b)).cast("double"))
    x = _bind(x, _z1=z1, _z2=F.abs(z2), _z3=F.abs(z3))
    x = _bind(x, **{f"_t{k}": 1 / (1 + 0.2316419 * F.abs(f"_z{k}")) for k in (1, 2, 3)})
    x = _bind(x, **{f"_p{k}": _upper_tail(F.col(f"_z{k}"), F.col(f"_t{k}")) for k in (1, 2, 3)})
    x = _bind(x, _s=F.greatest(F.lit(0.0), -F.log("_p1") - F.log(2 * F.col("_p2")) - F.log(2 * F.col("_p3"))))
    x = x.withColumn("random_p", F.exp(-F.col("_s")) * (1 + F.col("_s") + F.col("_s") * F.col("_s") / 2))
    return x.select(*df.columns, "random_p", F.col("_m").cast("int").alias("letters"))


def combined_p(tested: DataFrame) -> DataFrame:
    """tested (prose, random_p, letters, lengths, ...) with p: both p-values under prose as one.

    The tails are counted in bins, a few thousand at most for all alphabets and lengths.
    """
    x = tested.withColumn("rbin", F.floor(-4 * F.log(F.greatest("random_p", F.lit(1e-300)))).cast("int"))
    own = ["letters", "lengths"]
    nulls = x.groupBy(*own, "rbin").agg(F.sum((F.col("prose") >= 1).cast("long")).alias("n"))
    tail = F.sum("n").over(Window.partitionBy(*own).orderBy("rbin"))
    tails = nulls.select(*own, "rbin", ((1 + tail) / (1 + F.sum("n").over(Window.partitionBy(*own)))).alias("battery"))
    x = x.join(F.broadcast(tails), [*own, "rbin"])
    return x.withColumn("p", F.least(F.lit(1.0), 2 / (1 / F.col("prose") + 0.5 / F.sqrt("battery")))).select(*tested.columns, "p")


def _ranked(kind: str, rank: int) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, extra): arrays of (start, rank of kind, end, kind), sorted; base of the patterns, extra of the battery."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text", t)
    scan = rows.select("id", F.monotonically_increasing_id().alias("row"), *[_matches(F.col("text"), p, g, n, hint).alias(k) for k, p, g, n, hint in KINDS], _matches(F.col("text"), f"[{SIGN}]+", 0, LEAST, f"(?<![{SIGN}])[{SIGN}]{{{LEAST}}}").alias("run"))
    base = F.array_sort(F.concat(*[_ranked(k, i) for i, (k, *_) in enumerate(KINDS)]))
    scan = scan.withColumn("base", base)
    free = F.flatten(F.transform("run", lambda r: _parts(r, F.col("base")))).cast(SPAN)
    scan = stored(scan.select("id", "row", "base", free.alias("run")), "secret-scan")

    runs = scan.where(F.size("run") > 0).select("row", F.explode("run").alias("r")).select("row", "r.*").withColumn("prose", prose_p(F.col("tok"))).withColumn("lengths", F.floor(F.log2(F.col("end") - F.col("start"))).cast("int"))
    tested = stored(random_p(runs, "tok").drop("tok"), "secret-runs")
    live = stored(combined_p(tested).where((F.col("random_p") >= ALPHA) & (F.col("p") < 1)).withColumn("bin", F.floor(-4 * F.log("p")).cast("int")), "secret-live")
    total = tested.groupBy("lengths").agg(F.count("*").alias("all"))
    counts = live.groupBy("lengths", "bin").agg(F.count("*").alias("n"), F.max("p").alias("p"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("lengths").orderBy(F.desc("bin"))))
    accept = upto.join(F.broadcast(total), "lengths").where(F.col("p") <= F.lit(FDR) * F.col("upto") / F.col("all")).groupBy("lengths").agg(F.min("bin").alias("from_bin"))  # a row for each power of two
    extra = live.join(F.broadcast(accept), "lengths").where("bin >= from_bin")
    extra = extra.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit("random").alias("kind")))).alias("extra"))
    out = scan.join(extra, "row", "left")
    return out.select(F.col("id").alias(id_col), "base", F.coalesce("extra", F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)")).alias("extra"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
