"""Secret scan: fixed patterns, and a battery of randomness tests. DataFrame expressions only.

Long runs of key characters are candidates; of a run with characters of both base64
and base64url, which fits no encoding, the pieces between those of either are.
From its characters each candidate gets an encoding, and with the numbers of its characters in that alphabet three tests of
randomness: chi-squared uniformity, runs above and below the middle, and serial
correlation. A secret is random, so it must not fail them. But neither do short
words fail them. So each candidate is also tested against text: the chi-squared
statistic of text of the same length and alphabet has a known mean and spread, and
lies the further from that of random characters the longer they are. False
discoveries among all candidates of the corpus are controlled in classes of length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfmine.llm.common import id_and_text, staged

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
#: Share of false discoveries among the random runs that are reported.
FALSE_DISCOVERIES = 0.01
#: A run whose least p-value of three tests is below this is not random.
LEAST_P = 0.001
#: Histogram bins per factor of ten of a p-value, and the number of bins.
BINS_PER_DECADE, BINS = 20, 400

# fixed values: the base patterns
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
RUN_LEAST = "[A-Za-z0-9+/_-]{20}"
#: Characters that base64 has and base64url has not, and the other way round.
CUTS = ("[+/]", "[_-]")

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: encoding, smallest alphabets first, as a key of a larger one would have its other characters:
#: pattern, alphabet, and of what text would be written in it the chance that two
#: characters, and that three, are equal (for decimal digits the dates yyyymmdd of 2000 to 2029,
#: for hexadecimal ones decimal digits; letters of European languages)
ENCODINGS = {
    "decimal": ("^[0-9]+=*$", _DIGITS, 0.2097, 0.0574),
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.1, 0.01),
    "lower": ("^[a-z]+=*$", _LOWER, 0.0667, 0.0055),
    "upper": ("^[A-Z]+=*$", _UPPER, 0.0667, 0.0055),
    "base32": ("^[A-Z2-7]+=*$", f"{_UPPER}234567", 0.0667, 0.0055),
    "base32lower": ("^[a-z2-7]+=*$", f"{_LOWER}234567", 0.0667, 0.0055),
    "loweralnum": ("^[a-z0-9]+=*$", f"{_DIGITS}{_LOWER}", 0.0667, 0.0055),
    "upperalnum": ("^[A-Z0-9]+=*$", f"{_DIGITS}{_UPPER}", 0.0667, 0.0055),
    "letters": ("^[A-Za-z]+=*$", f"{_UPPER}{_LOWER}", 0.0667, 0.0055),
    "alnum": ("^[A-Za-z0-9]+=*$", f"{_DIGITS}{_UPPER}{_LOWER}", 0.0667, 0.0055),
    "base64": ("^[A-Za-z0-9+/]+=*$", f"{_UPPER}{_LOWER}{_DIGITS}+/", 0.0667, 0.0055),
    "base64url": ("^[A-Za-z0-9_-]+=*$", f"{_UPPER}{_LOWER}{_DIGITS}-_", 0.0667, 0.0055),
}


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, to seven digits."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    # fixed values: a published polynomial for the normal tail
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / (2 * 3.141592653589793) ** 0.5 * series
    return F.when(z >= 0, upper).otherwise(1 - upper)


def hits(text: Column, pattern: str, kind: str) -> Column:
    """The matches of a pattern with the length of the text since the one before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.zip_with(gaps, found, lambda gap, hit: F.struct(F.lit(kind).alias("kind"), gap.cast("long").alias("gap"), hit.alias("hit")))
    return F.filter(parts, lambda p: p["hit"].isNotNull())


def in_pieces(spans: DataFrame) -> DataFrame:
    """``spans`` with ``piece``, false, but for random runs that fit no encoding: their pieces instead.

    Such a run is cut at '+' and '/', as paths are, and once more at '-' and '_',
    as prefixes are. Every piece of 20 characters or more is a candidate; those
    of the two ways may overlap.
    """
    mixed = (F.col("kind") == "random") & F.col("hit").rlike(CUTS[0]) & F.col("hit").rlike(CUTS[1])
    ways = spans.where(mixed).select("row", "kind", F.col("start").alias("run"), F.posexplode(F.array(*[F.split("hit", cut) for cut in CUTS])).alias("way", "hits"))
    each = ways.select("row", "kind", "run", "way", F.posexplode("hits").alias("at", "hit"))
    before = Window.partitionBy("row", "run", "way").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("run") + F.sum(F.length("hit") + 1).over(before) - 1
    pieces = each.withColumn("end", end).where(F.col("hit").rlike(RUN_LEAST))
    pieces = pieces.select("row", "kind", "hit", "end", (F.col("end") - F.length("hit")).alias("start"), F.lit(True).alias("piece"))
    return spans.where(~mixed).select("row", "kind", "hit", "end", "start", F.lit(False).alias("piece")).unionByName(pieces)


def located(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` as (row, doc_id), and its matches as (row, kind, start, end, hit, piece)."""
    text = F.col("text")
    none = F.array().cast("array<struct<kind:string,gap:bigint,hit:string>>")
    folded = F.lower(text)
    named = folded.contains(ASSIGN_WORDS[0])
    for word in ASSIGN_WORDS[1:]:
        named = named | folded.contains(word)
    parts = F.concat(
        F.when(named, hits(text, ASSIGN, "assign")).otherwise(none),
        F.when(text.contains("AKIA"), hits(text, ACCESS, "access")).otherwise(none),
        F.when(text.rlike("[0-9a-f]{24}"), hits(text, HEX, "hex")).otherwise(none),
        F.when(text.rlike(RUN_LEAST), hits(text, RUN, "random")).otherwise(none),
    )
    # numbered once and written, so that a task that runs again cannot number anew
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", parts.alias("parts")), "secret-hits")
    each = rows.where(F.size("parts") > 0).select("row", F.posexplode("parts").alias("at", "part")).select("row", "at", "part.*")
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(upto)
    spans = each.select("row", "kind", "hit", end.alias("end")).withColumn("start", F.col("end") - F.length("hit"))
    value = F.regexp_extract("hit", ASSIGN, 2)
    fine = (
        F.when(F.col("kind") == "assign", F.length(value) >= ASSIGN_LEAST).when(F.col("kind") == "access", F.length("hit") >= ACCESS_LEAST).otherwise(True)
    )
    return rows.select("row", "doc_id"), in_pieces(spans.where(fine))


def tested(runs: DataFrame) -> DataFrame:
    """``runs`` with encoding, n, p_random (the least of three tests, thrice) and p_text of ``hit``.

    What the tests need of a run is a few sums. They are written as a table, so
    that the formulas over them do not walk its characters again and again.
    """
    choose = lambda k: F.coalesce(*[F.when(F.col("hit").rlike(v[0]), F.lit(v[k] if k else name)) for name, v in ENCODINGS.items()])
    rows = runs.withColumns({"encoding": choose(0), "alphabet": choose(1), "pair": choose(2), "triple": choose(3)})
    rows = rows.where("encoding is not null")
    body = F.regexp_replace("hit", "=+$", "")
    body = F.when(F.col("encoding") == "hex", F.lower(body)).otherwise(body)
    x = F.transform(F.split(body, ""), lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double"))
    rows = rows.withColumn("x", x).withColumns({"n": F.size("x").cast("double"), "k": F.length("alphabet").cast("double")})

    counted = F.aggregate(
        F.array_sort("x"),
        F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares")),
        lambda a, v: F.struct(
            v.alias("last"),
            F.when(v == a["last"], a["run"] + 1).otherwise(1.0).alias("run"),
            (a["squares"] + 2 * F.when(v == a["last"], a["run"]).otherwise(0.0) + 1).alias("squares"),
        ),
        lambda a: a["squares"],
    )
    middle = (F.col("k") - 1) / 2
    walked = F.aggregate(
        "x",
        F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("above"), F.lit(0.0).alias("serial")),
        lambda a, v: F.struct(
            v.alias("last"),
            (a["runs"] + F.when(a["last"].isNull() | ((v > middle) != (a["last"] > middle)), 1.0).otherwise(0.0)).alias("runs"),
            (a["above"] + F.when(v > middle, 1.0).otherwise(0.0)).alias("above"),
            (a["serial"] + F.coalesce((v - middle) * (a["last"] - middle), F.lit(0.0))).alias("serial"),
        ),
    )
    rows = staged(rows.withColumns({"squares": counted, "w": walked}).drop("x", "hit", "alphabet"), "secret-runs")
    n, k = F.col("n"), F.col("k")
    chi = k / n * F.col("squares") - n
    free = k - 1
    # the cube root of a chi-squared variable is nearly normal
    z_chi = (F.pow(chi / free, 1 / 3) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    above = F.col("w.above")
    expected = 2 * above * (n - above) / n + 1
    z_runs = F.when(expected > 2, F.abs(F.col("w.runs") - expected) / F.sqrt((expected - 1) * (expected - 2) / (n - 1))).otherwise(10.0)
    z_serial = F.abs(F.col("w.serial")) / ((k * k - 1) / 12 * F.sqrt(n - 1))
    p_random = F.least(F.lit(1.0), 3 * F.least(normal_tail(z_chi), 2 * normal_tail(z_runs), 2 * normal_tail(z_serial)))
    c = F.col("pair")
    text_mean = k + k * (n - 1) * c - n
    text_spread = k / n * F.sqrt(2 * n * (n - 1) * c * (1 - c) + 4 * n * (n - 1) * (n - 2) * (F.col("triple") - c * c))
    p_text = normal_tail((text_mean - chi) / text_spread)
    return rows.withColumns({"p_random": p_random, "p_text": p_text}).drop("squares", "w", "pair", "triple", "k")


def discovered(runs: DataFrame, share: float = FALSE_DISCOVERIES) -> DataFrame:
    """The ``tested`` runs that are random and, at that share of false discoveries, not text.

    Step-up control over all runs of a class of length (a doubling), on a
    histogram of p-values: at most ``BINS`` + 1 rows a class, one class per
    doubling, whatever the corpus. A p-value counts as its bin's upper end.
    """
    nearest = F.greatest(F.col("p_text"), F.lit(10.0 ** (-BINS / BINS_PER_DECADE)))
    rows = runs.withColumns(
        {"size": F.floor(F.log2("n")).cast("int"), "bin": F.least(F.lit(BINS), F.floor(-F.log10(nearest) * BINS_PER_DECADE)).cast("int")}
    )
    counts = rows.groupBy("size", "bin").agg(F.count("*").alias("runs"))
    down = Window.partitionBy("size").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.partitionBy("size")
    steps = counts.withColumns({"found": F.sum("runs").over(down), "all": F.sum("runs").over(all_of)})
    passed = F.col("all") * F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) <= share * F.col("found")
    limits = steps.where(passed).groupBy("size").agg(F.min("bin").alias("limit"))
    return rows.join(F.broadcast(limits), "size").where((F.col("bin") >= F.col("limit")) & (F.col("p_random") >= LEAST_P)).drop("size", "bin", "limit")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row; spans are (kind, start, end, base) in code points, by start, then kind.

    The base kinds are always reported; ``random`` spans only where no base span
    is. Of the pieces of a run, those inside another reported one are left out;
    others may overlap. Null and empty texts have no spans. A null id is kept, and repeated rows
    are searched each, but count in the control of false discoveries. Matches,
    not texts, are shuffled; one document's matches are brought together, never
    those of several.
    """
    rows, spans = located(id_and_text(docs, id_col, text_col))
    base = spans.where(F.col("kind") != "random").select("row", "kind", "start", "end", F.lit(True).alias("base"), F.lit(False).alias("piece"))
    runs = discovered(tested(spans.where(F.col("kind") == "random")))
    random = runs.select("row", "kind", "start", "end", F.lit(False).alias("base"), "piece")
    order = F.array_position(F.lit(list(KINDS)), F.col("kind"))
    together = (
        base.unionByName(random)
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", order.alias("order"), "end", "kind", "base", "piece"))).alias("found"))
    )
    fixed = F.filter("found", lambda s: s["base"])
    clear = F.filter("found", lambda s: s["base"] | ~F.exists(fixed, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    pieces = F.filter("clear", lambda s: s["piece"])
    inside = lambda s: F.exists(pieces, lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (o["end"] - o["start"] > s["end"] - s["start"]))
    outer = F.filter("clear", lambda s: ~s["piece"] | ~inside(s))
    spans = F.transform(outer, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    together = together.select("row", clear.alias("clear")).select("row", spans.alias("spans"))
    return rows.join(together, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))
