"""Secret scans: fixed patterns, and character Markov models for what has no pattern.

Two first-order Markov models over the characters a key can hold, one of random strings and one of
ordinary identifiers, are trained from labelled samples. A run of such characters is a secret when
the log-likelihood ratio of the two models exceeds a threshold. Only column functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import bind, running_starts
from fieldspark.operators.ordered import null_safe_join
from fieldspark.sources.stage import materialise

# Fixed values of the base rules; letters of the key word in either case.
KEY_WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = (r"""("""
          + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in KEY_WORDS)
          + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
STATES = len(ALPHABET) + 1          # state 0 is the start of a run
RUN_LEAST = 20
THRESHOLD = 12.0                    # nats of evidence for a random string, at least
RATE = 2.25                         # and as many per character with samples out of a corpus
RULED = "=-_+/"                     # signs that ruled lines repeat
SMOOTHING = 0.5                     # of the characters' own frequencies
PRIOR = 4.0                         # transitions that these count for in each state
GENERATED = 3000                    # random strings of each alphabet among the labelled samples


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def spans(kind: int, pattern: str, group: int, least: int, screen: str | None = None) -> str:
    """SQL array of (start, kind, end) for the leftmost non-overlapping matches in ``text`` whose
    ``group`` has ``least`` characters; positions in code points."""
    p = _quoted(pattern)
    value = f"regexp_extract_all(text, {p}, {group})"
    found = bind(f"regexp_extract_all(text, {p}, 0)", "m -> " + bind(
        f"transform(slice(split(text, {p}, -1), 1, size(m)), s -> cast(length(s) as bigint))", "g -> " + bind(
            running_starts("zip_with(g, m, (a, b) -> a + length(b))"),
            "s -> zip_with(zip_with(s, g, (a, b) -> a + b), m, (a, b) -> "
            f"struct(a AS start, {kind} AS kind, a + length(b) AS end))")))
    fit = found if group == 0 and least == 0 else bind(
        found, f"f -> transform(filter(zip_with(f, {value}, (x, y) -> struct(x, y)), z -> length(z.y) >= {least}), z -> z.x)")
    none = "cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)"
    return f"CASE WHEN text RLIKE {_quoted(screen or pattern)} THEN {fit} ELSE {none} END"


# A text can only hold a long enough hex run or access key if it matches these.
BASE = (f"concat({spans(0, ASSIGN, 2, ASSIGN_LEAST)}, "
        f"{spans(1, ACCESS, 0, ACCESS_LEAST, ACCESS.replace('+', '{%d,}' % (ACCESS_LEAST - 4)))}, "
        f"{spans(2, HEX, 0, HEX_LEAST, HEX.replace('+', '{%d,}' % HEX_LEAST))})")
_CODES = "array(" + ",".join(str(ALPHABET.find(chr(i)) + 1) for i in range(128)) + ")"


def steps(run: str) -> str:
    """SQL array of transition numbers of a run of key characters, from the start state on."""
    codes = f"transform(filter(split({run}, ''), c -> c <> ''), c -> {_CODES}[ascii(c)])"
    return bind(codes, f"c -> transform(sequence(0, size(c) - 1), i -> if(i = 0, 0, c[i - 1]) * {STATES} + c[i])")


def train(samples: DataFrame) -> DataFrame:
    """One row with ``ratio``: for every transition the log of random over ordinary likelihood.

    ``samples`` has (run, random): runs of key characters and whether they are random. With no
    sample of a kind its model is uniform; a rare state leans on the characters' own frequencies. The row has one entry for each pair of states, whatever
    the size of the samples.
    """
    seen = (samples.where("length(run) > 0")
            .select(F.col("random"), F.explode(F.expr(steps("run"))).alias("t"))
            .groupBy("t").agg(F.sum(F.when(F.col("random"), 1).otherwise(0)).alias("r"),
                              F.sum(F.when(F.col("random"), 0).otherwise(1)).alias("o")))
    grid = samples.sparkSession.range(STATES * STATES).withColumnRenamed("id", "t").join(
        F.broadcast(seen.withColumn("t", F.col("t").cast("long"))), "t", "left").fillna(0)
    grid = grid.withColumn("a", F.floor(F.col("t") / STATES)).withColumn("b", F.col("t") % STATES)
    source = grid.groupBy("a").agg(F.sum("r").alias("ra"), F.sum("o").alias("oa"))
    target = grid.groupBy("b").agg(F.sum("r").alias("rb"), F.sum("o").alias("ob"))
    whole = grid.agg(F.sum("r").alias("rn"), F.sum("o").alias("on"))
    full = null_safe_join(grid.join(F.broadcast(source), "a").join(F.broadcast(target), "b"), whole, [])

    def chance(n: str, of: str, plain: str, every: str):
        low = (F.col(plain) + SMOOTHING) / (F.col(every) + SMOOTHING * STATES)
        return (F.col(n) + PRIOR * low) / (F.col(of) + PRIOR)

    cell = full.select("t", F.ln(chance("r", "ra", "rb", "rn") / chance("o", "oa", "ob", "on")).cast("float").alias("x"))
    return materialise(cell.agg(F.expr("transform(array_sort(collect_list(struct(t, x))), e -> e.x)").alias("ratio")))


def generated(spark: SparkSession, each: int = GENERATED, seed: str = "sample") -> DataFrame:
    """Random strings in hexadecimal, base 64, mixed letters and digits, and capital letters with
    digits."""
    ids = spark.range(each)
    h = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    coded = F.base64(F.unhex(h))
    return ids.select(F.explode(F.array(
        F.substring(h, 1, 40), F.rtrim(coded), F.translate(F.substring(coded, 1, 32), "+/=", "k7Q"),
        F.translate(F.upper(F.substring(coded, 1, 24)), "+/=", "Q7Z"))).alias("run"),
        F.lit(True).alias("random"))


def labelled_runs(texts: DataFrame, least: int = RUN_LEAST) -> DataFrame:
    """Labelled samples out of all ``texts``: distinct values of the base rules are random. What the
    base rules leave is ordinary where a run occurs twice or more and is either shorter than
    ``least`` or has letters, low lines and hyphens only; it counts as written, in capitals, and
    joined to itself as in a compound name and in a path.

    Words are counted where they are read, so a word travels once per task."""
    assign = _quoted(ASSIGN)
    values = F.expr(
        f"CASE WHEN text RLIKE {assign} THEN filter(regexp_extract_all(text, {assign}, 2), v -> length(v) >= 16 AND v RLIKE '[0-9]') "
        f"ELSE cast(array() as array<string>) END")
    plain = F.expr(f"CASE WHEN text RLIKE {assign} THEN regexp_replace(text, {assign}, ' ') ELSE text END")
    words = F.filter(F.regexp_extract_all(plain, F.lit(RUN % 3), F.lit(0)),
                     lambda w: (F.length(w) < least) | ~w.rlike("[0-9+/=]"))
    both = texts.select(F.explode(F.concat(
        F.transform(values, lambda v: F.struct(F.translate(v, ".", "").alias("run"), F.lit(True).alias("random"))),
        F.transform(words, lambda w: F.struct(w.alias("run"), F.lit(False).alias("random"))))).alias("s"))
    seen = both.groupBy("s.run", "s.random").agg(F.count(F.lit(1)).alias("n")).where("random OR n > 1")
    # Ordinary runs join words by a capital or a slash; ruled lines repeat one sign.
    joined = [F.concat("run", F.initcap("run")), F.concat_ws("/", "run", F.lower("run"))]
    forms = F.when(F.col("random"), F.array("run")).otherwise(F.array_distinct(F.array("run", F.upper("run"), *joined)))
    ruled = texts.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c * 64) for c in RULED])).alias("run"), F.lit(False).alias("random"))
    return seen.select(F.explode(forms).alias("run"), "random").union(ruled)


def find_secrets(docs: DataFrame, text: str, model: DataFrame, out: str = "secrets",
                 least: int = RUN_LEAST, threshold: float = THRESHOLD, rate: float = 0.0) -> DataFrame:
    """``docs`` with the array ``out`` of (start, kind, end) ordered by start and kind.

    A run counts as random from ``threshold`` nats on and ``rate`` nats per character.

    Kinds 0 to 2 are the base rules, 3 the Markov models' own finds, which never overlap a base
    span: a run is cut at those, and every piece of ``least`` characters is scored. A null text counts as empty. Other columns pass through, whatever their names.
    """
    kept = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(docs.columns)]
    at = docs.columns.index(text)
    rows = docs.select(*kept).withColumn("text", F.coalesce(f"_k{at}", F.lit("")))
    run = RUN % least
    rows = rows.withColumn("_base", F.expr(BASE)).withColumn("_runs", F.expr(spans(3, run, 0, 0)))
    # Where base spans overlap a run, its pieces start at the run's start or at a span's end, and end
    # at the next span's start or the run's end.
    over = "filter(_base, b -> r.start < b.end AND b.start < r.end)"
    pieces = bind(over, "o -> if(size(o) = 0, array(r), filter(transform("
                  "filter(array_distinct(concat(array(r.start), transform(o, b -> b.end))), x -> x >= r.start AND x < r.end AND NOT exists(o, b -> b.start <= x AND x < b.end)), "
                  "x -> struct(x AS start, 3 AS kind, aggregate(o, r.end, (e, b) -> if(b.start > x, least(e, b.start), e)) AS end)), "
                  f"p -> p.end - p.start >= {least}))")
    rows = rows.withColumn("_runs", F.expr(f"flatten(transform(_runs, r -> {pieces}))"))
    joined = null_safe_join(rows, model, [])
    score = (f"aggregate({steps('substring(text, cast(r.start + 1 as int), cast(r.end - r.start as int))')}, 0D, (a, t) -> a + ratio[t])")
    own = F.expr(f"filter(_runs, r -> {score} >= greatest({threshold}D, {rate}D * (r.end - r.start)))")
    none = F.size("_runs") == 0
    found = F.sort_array(F.when(none, F.col("_base")).otherwise(F.concat("_base", own)))
    return joined.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)], found.alias(out))


def redacted(text: str, secrets: str, mark: str = "[SECRET]") -> str:
    """SQL: ``text`` with every span of ``secrets`` replaced; overlapping spans give one mark."""
    merged = (f"aggregate({secrets}, cast(array() as array<struct<start: bigint, end: bigint>>), (a, s) -> "
              "if(size(a) > 0 AND s.start < element_at(a, -1).end, "
              "concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start AS start, greatest(element_at(a, -1).end, s.end) AS end))), "
              "concat(a, array(struct(s.start AS start, s.end AS end)))))")
    gaps = ("transform(sequence(0, size(a)), i -> substring({t}, cast(if(i = 0, 0L, a[i - 1].end) + 1 as int), "
            "cast(if(i = size(a), length({t}), a[least(i, size(a) - 1)].start) - if(i = 0, 0L, a[i - 1].end) as int)))").format(t=text)
    return f"if(size({secrets}) = 0, {text}, {bind(merged, f'a -> array_join({gaps}, {chr(39)}{mark}{chr(39)})')})"


def span_text(secrets: str, kinds: int) -> str:
    """SQL: ``kind:start:end`` of the first ``kinds`` kinds, comma-joined."""
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return (f"array_join(transform(filter({secrets}, s -> s.kind < {kinds}), "
            f"s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')")
