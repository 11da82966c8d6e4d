"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings. DataFrame functions only.

Patterns (leftmost, non-overlapping, by kind): `assign`, `access`, `hex`. Beside them, a candidate is a run of 20 or
more of A-Z a-z 0-9 + / _ = - , cut by + / _ = - into parts. A window of 20 characters slides over it. The counts of
all characters of the window are kept: at each step the one that leaves and the one that enters change their counts,
and with them the sum of n log2 n that gives the entropy. A candidate is reported as `entropy` if one of its windows
reaches the threshold of its class: `hex` (what is open holds hexadecimal digits only), `alnum` (one part is open)
or `base64`.

The allow-list closes parts that read as words, names or numbers (words run together in camel case too, digits only
at an end), UUIDs, the words of ALLOWED, and parts directly beside one of these; parts of up to three characters stay
open beside an open part. A window counts only if 16 of its 20
characters lie in open parts, so a key is found whatever words and paths stand around it, and words are not. A random
key of letters of one case alone cannot be told from words and is passed over. Candidates inside a pattern's span are
reported by the pattern.

Places come from running sums of the lengths of matches and of the gaps between them, made in blocks, so the work
grows with the text and not with the square of its matches. Starts and ends are code points, ends exclusive. Null and
empty texts give no spans. Repeated rows are scanned alike. An empty table gives an empty result. Other columns are
not carried. Texts without a match cost one pass of each pattern; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, table

# The patterns of the three kinds, and the least characters of each.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: So many characters of a window must lie in open parts.
LEAST_OPEN = 16
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
UUID = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])"
#: What a UUID is read as: a word of the same length.
UUID_WORD = "u" * 36
#: A word, name or number; of several words run together each has two small letters or more.
WORDLIKE = r"^([A-Z]?[a-z]*|[A-Z]*|([A-Z]{0,4}[a-z]{2,}|[A-Z][a-z])+[A-Z]{0,4})[0-9]*$|^[0-9]+[a-z]{0,3}$"
#: Parts of so few characters say little: beside an open part they are open too.
SHORT = 3
ALLOWED = r"(?i)^(example|sample|dummy|placeholder|test)s?$"
KINDS = ("assign", "access", "hex", "entropy")
_SPANS = "array<struct<start:int,order:int,end:int,kind:string,text:string>>"
#: Running values are made in blocks of so many.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once however often it is named."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints what step has made of 0 and all values before it, and at last the whole.

    Each block is folded by itself and then the blocks' totals are: n values cost n * BLOCK + (n / BLOCK)^2 copies.
    """

    def fold(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen"))
        return F.aggregate(part, start, lambda s, v: F.struct(step(s["at"], v).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen")))

    def whole(own: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda b: fold(F.slice(own, b * BLOCK + 1, F.lit(BLOCK))))
        joined = lambda blocks: let(fold(F.transform(blocks, lambda b: b["at"])), lambda outer: F.concat(F.flatten(F.transform(blocks, lambda b, i: F.transform(b["seen"], lambda v: step(outer["seen"][i], v)))), F.array(outer["at"])))
        return let(cut, joined)

    return let(values, lambda own: F.when(F.size(own) == 0, F.array(F.lit(0))).otherwise(whole(own)))


def located(text: Column, pattern: str, kind: str) -> Column:
    """All matches with their places: what split() leaves between them gives the distances."""

    def spans(found: Column, gaps: Column) -> Column:
        sizes = F.transform(found, lambda t, i: F.length(gaps[i]) + F.length(t))
        placed = lambda before: F.transform(
            found, lambda t, i: F.struct((before[i + 1] - F.length(t)).alias("start"), F.lit(KINDS.index(kind)).alias("order"), before[i + 1].alias("end"), F.lit(kind).alias("kind"), t.alias("text"))
        )
        return let(running(sizes, lambda s, v: s + v), placed)

    made = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda gaps: spans(found, gaps)))
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast(_SPANS))


def outside(base: Column, candidates: Column) -> Column:
    """The candidates that lie in no base span: in order of their starts, the farthest end of a base span so far stops short of theirs."""
    ends = lambda spans: F.transform(spans, lambda s: F.when(s["kind"] == "entropy", F.lit(0)).otherwise(s["end"]))
    free = lambda spans: let(running(ends(spans), F.greatest), lambda reached: F.filter(F.transform(spans, lambda s, i: F.when((s["kind"] == "entropy") & (reached[i] < s["end"]), s)), lambda s: s.isNotNull()))
    return F.when(F.size(candidates) == 0, candidates).otherwise(let(F.sort_array(F.concat(base, candidates)), free))


def _weight(n: Column) -> Column:
    """n log2 n."""
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def highest_entropy(text: Column, open_: Column) -> Column:
    """The highest Shannon entropy, in bits, of the windows of a text in ALPHABET that are open enough; open_: 1 or 0 for each character."""

    def over(letters: Column, flags: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            enters, leaves = letters[i - 1], F.when(i > WINDOW, letters[i - WINDOW - 1]).otherwise(F.lit(0))
            lost, gained = F.when(leaves > 0, state["counts"][leaves - 1]).otherwise(F.lit(0)), state["counts"][enters - 1]
            gained = gained - F.when(enters == leaves, F.lit(1)).otherwise(F.lit(0))
            total = state["sum"] - _weight(lost) + _weight(lost - 1) - _weight(gained) + _weight(gained + 1)
            counts = F.transform(state["counts"], lambda n, k: n + F.when(k == enters - 1, 1).otherwise(0) - F.when(k == leaves - 1, 1).otherwise(0))
            held = state["open"] + flags[i - 1] - F.when(i > WINDOW, flags[i - WINDOW - 1]).otherwise(F.lit(0))
            entropy = F.log2(F.lit(float(WINDOW))) - total / WINDOW
            best = F.when((i >= WINDOW) & (held >= LEAST_OPEN), F.greatest(state["best"], entropy)).otherwise(state["best"])
            return F.struct(counts.alias("counts"), total.alias("sum"), held.alias("open"), best.alias("best"))

        start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("open"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(letters)), start, step)["best"]

    numbers = F.transform(F.filter(F.split(text, "", -1), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(numbers, lambda letters: let(open_, lambda flags: over(letters, flags)))


def suspicious(text: Column) -> Column:
    """Whether an open window of a candidate reaches its class's threshold."""
    parts = F.split(F.regexp_replace(text, UUID, UUID_WORD), "[+/_=-]", -1)
    near = lambda parts, i: F.coalesce(F.get(parts, i), F.lit("")).rlike(ALLOWED)
    allowed = lambda parts, i: near(parts, i) | near(parts, i - 1) | near(parts, i + 1)
    strange = lambda parts: F.transform(parts, lambda p, i: F.when(p.rlike(WORDLIKE) | allowed(parts, i), F.lit(0)).otherwise(F.lit(1)))
    beside = lambda odd, i: (F.coalesce(F.get(odd, i - 1), F.lit(0)) == 1) | (F.coalesce(F.get(odd, i + 1), F.lit(0)) == 1)
    opened = lambda parts: let(strange(parts), lambda odd: F.transform(parts, lambda p, i: F.when((odd[i] == 1) | (F.length(p).between(1, SHORT) & beside(odd, i) & ~allowed(parts, i)), F.lit(1)).otherwise(F.lit(0))))

    def judged(parts: Column, flags: Column) -> Column:
        shown = F.filter(parts, lambda p, i: flags[i] == 1)
        each = F.flatten(F.transform(parts, lambda p, i: F.array_repeat(flags[i], F.length(p) + 1)))  # a sign counts with the part before it
        threshold = F.when(~F.exists(shown, lambda p: p.rlike("[^0-9A-Fa-f]")), THRESHOLDS["hex"]).when(F.size(shown) == 1, THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])
        return F.when(F.length(F.array_join(shown, "")) + F.size(shown) >= LEAST_OPEN, highest_entropy(text, each) >= threshold).otherwise(F.lit(False))

    return let(parts, lambda parts: let(opened(parts), lambda flags: judged(parts, flags)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and extra: arrays of spans (start, order, end, kind, text) by the patterns and by entropy."""
    docs = id_and_text(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    assign = F.filter(located(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= LEAST_VALUE)
    based = docs.select("doc_id", F.concat(assign, located(text, ACCESS, "access"), located(text, HEX, "hex")).alias("base"), located(text, CANDIDATE, "entropy").alias("candidates"))
    return based.select("doc_id", "base", F.filter(outside(F.col("base"), F.col("candidates")), lambda s: suspicious(s["text"])).alias("extra"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.concat("base", "extra")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(spans).alias("spans"))


OP10_SQL = """
WITH kinds(kind, ord, pattern) AS (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]{24,}'), ('entropy', 3, '[A-Za-z0-9+/_=-]{20,}')),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT doc_id, 'assign' AS kind, 0 AS ord, regexp_extract_all(text, (SELECT pattern FROM kinds WHERE ord = 0)) AS found, string_split_regex(text, (SELECT pattern FROM kinds WHERE ord = 0)) AS gaps FROM d
  UNION ALL SELECT doc_id, 'access', 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 'hex', 2, regexp_extract_all(text, '[0-9a-f]{24,}'), string_split_regex(text, '[0-9a-f]{24,}') FROM d
  UNION ALL SELECT doc_id, 'entropy', 3, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), string_split_regex(text, '[A-Za-z0-9+/_=-]{20,}') FROM d),
s AS (
  SELECT doc_id, kind, ord, x.t AS t, x.s AS s, x.s + length(x.t) AS e FROM (
    SELECT doc_id, kind, ord, unnest(list_transform(range(1, len(found) + 1), lambda i: {
      't': found[i],
      's': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0)})) AS x
    FROM m WHERE len(found) > 0)),
base AS (
  SELECT * FROM s WHERE ord = 2 OR ord = 1 AND length(t) >= 20
    OR ord = 0 AND length(regexp_extract(t, (SELECT pattern FROM kinds WHERE ord = 0), 2)) >= 6),
candidates AS (
  SELECT *, string_split_regex(regexp_replace(t, '(^|[^0-9A-Za-z])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}($|[^0-9A-Za-z])', '\\1uuuuuuuuuuuuuuuuuuuuuuuuuuuuuuuuuuuu\\2', 'g'), '[+/_=-]') AS parts
  FROM s c WHERE ord = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s <= c.s AND c.e <= b.e)),
allowed AS (SELECT *, list_transform(parts, lambda p: regexp_matches(p, '(?i)^(example|sample|dummy|placeholder|test)s?$')) AS said FROM candidates),
beside AS (SELECT *, list_transform(range(1, len(parts) + 1), lambda i: said[i] OR coalesce(said[i + 1], false) OR (i > 1 AND said[greatest(i - 1, 1)])) AS near FROM allowed),
odd AS (SELECT *, list_transform(range(1, len(parts) + 1), lambda i: NOT (near[i] OR
    regexp_matches(parts[i], '^([A-Z]?[a-z]*|[A-Z]*|([A-Z]{0,4}[a-z]{2,}|[A-Z][a-z])+[A-Z]{0,4})[0-9]*$|^[0-9]+[a-z]{0,3}$'))) AS strange FROM beside),
parted AS (SELECT *, list_transform(range(1, len(parts) + 1), lambda i: (strange[i] OR (length(parts[i]) BETWEEN 1 AND 3 AND NOT near[i]
    AND (coalesce(strange[i + 1], false) OR (i > 1 AND strange[greatest(i - 1, 1)]))))::INT) AS flags FROM odd),
shown AS (SELECT *, list_transform(list_filter(range(1, len(parts) + 1), lambda i: flags[i] = 1), lambda i: parts[i]) AS open_parts, flatten(list_transform(range(1, len(parts) + 1), lambda i: list_transform(range(0, length(parts[i]) + 1), lambda k: flags[i]))) AS each FROM parted),
windows AS (SELECT doc_id, s, unnest(list_transform(list_filter(range(1, length(t) - 18), lambda i: list_sum(each[i:i + 19]) >= 16), lambda i: substr(t, i, 20))) AS w FROM shown WHERE length(array_to_string(open_parts, '')) + len(open_parts) >= 16),
entropy AS (
  SELECT doc_id, s, max(log2(20) - h / 20) AS best FROM (
    SELECT doc_id, s, list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: (20 - length(replace(w, c, ''))) * log2(20 - length(replace(w, c, ''))))) AS h FROM windows)
  GROUP BY ALL),
extra AS (
  SELECT c.* EXCLUDE (parts, said, near, strange, flags, open_parts, each) FROM shown c JOIN entropy USING (doc_id, s)
  WHERE best >= CASE WHEN NOT regexp_matches(array_to_string(open_parts, ''), '[^0-9A-Fa-f]') THEN 3.0 WHEN len(open_parts) = 1 THEN 3.6 ELSE 3.7 END),
together AS (SELECT *, true AS is_base FROM base UNION ALL SELECT *, false FROM extra)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, ord) FILTER (is_base), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, ord), '') AS spans
FROM d LEFT JOIN together USING (doc_id) GROUP BY d.doc_id
"""
