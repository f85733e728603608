r"""Personal data in texts, with Spark's own functions only.

Regular expressions propose spans: email, IP address, card number, phone number, IBAN,
social security number, Spanish and French identity numbers, secrets such as tokens.
Checksums and ranges confirm them (Luhn for cards, mod 97 for IBANs and French numbers,
mod 23 for Spanish ones, parts up to 255 for addresses, variety of characters for
secrets); words near a span raise or lower its score. Base kinds stay whatever their
score; added kinds need ``LEAST`` at least.

The patterns are written so that Java's engine needs no second try within a run of
characters: a run is entered at its start only (or where the last match ended), and
repetitions don't give back. They match what the plain patterns match, in linear time
and without deep recursion on very long runs. A match's place is the sum of the lengths
of the gaps and matches before it; lengths count code points. Sums run in blocks and
places near a match are read from pieces of the text, so a text with very many matches
takes time in proportion to its length.

A null text counts as empty; an empty table gives an empty result. Repeated rows give the
same result; extra columns are ignored. Spans of different kinds may overlap, and tie at
a start (the kind listed first comes first); ``redact`` masks their union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# Kinds in order, the base kinds first.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "dni", "nir", "secret")
BASE = 4

#: kind -> (what a text must contain to be searched, pattern)
PATTERNS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": ("", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": ("", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": ("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "dni": ("", r"(?<![A-Za-z0-9])[0-9]{8}-?[A-Z](?![A-Za-z0-9])"),
    "nir": ("", r"(?<![A-Za-z0-9])[12]\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![A-Za-z0-9])"),
    "secret": ("", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*+"),
}
#: kind -> (score alone, words that raise it, words that lower it)
CONTEXT = {
    "email": (0.90, "mail|contact|write", "example|noreply"),
    "ip": (0.70, "ip|host|address|server|login", "version|release|section|v"),
    "card": (0.80, "card|visa|mastercard|credit|payment|karte|carte|tarjeta", "order|serial|isbn|tracking"),
    "phone": (0.70, "phone|tel|call|mobile|fax|telefon|sms", "serial|order"),
    "iban": (0.90, "iban|account|bank|konto|compte|cuenta", "serial"),
    "ssn": (0.30, "ssn|social|security", "serial|part|order"),
    "dni": (0.30, "dni|nif|identidad", "serial|part|order"),
    "nir": (0.50, "nir|sécurité|sociale|insee", "serial|part|order"),
    "secret": (0.30, "token|secret|key|apikey|api_key|password|passwd|bearer|auth|credential", "commit|checksum|digest|md5|sha|sha1|sha256"),
}
# Fixed value: control letters by remainder modulo 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: A secret has letters, digits and this many different characters.
VARIETY = 10
NEAR = 40
STEP = 0.2
LEAST = 0.5


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    d = F.split(F.reverse(number), "")
    doubled = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
    values = F.transform(d, lambda x, i: F.when(i % 2 == 1, doubled(F.try_to_number(x, F.lit("9")).cast("int"))).otherwise(F.try_to_number(x, F.lit("9")).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97."""
    turned = F.split(F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4)), "")

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(c == "", a).when(code < 65, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(digits(m))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    if kind == "dni":
        return F.substring(F.lit(DNI_LETTERS), F.substring(m, 1, 8).cast("int") % 23 + 1, F.lit(1)) == F.substring(m, -1, 1)
    if kind == "nir":
        number = F.regexp_replace(m, " ", "")
        return F.substring(number, 1, 13).cast("long") % 97 + F.substring(number, 14, 2).cast("int") == 97
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= VARIETY)
    return F.lit(True)


#: Values in a block of a running sum; characters in a piece of a text.
BLOCK = 256
PIECE = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though a lambda in it uses it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, merge) -> Column:
    """Running ``merge`` (sum or maximum, say) over an array of ints.

    An array grows by copying, so values are taken in blocks: one scan in each, one over
    the blocks' last values.
    """
    none = F.expr("cast(array() as array<int>)")

    def scan(x: Column) -> Column:
        more = lambda a, v: F.concat(a, F.array(F.coalesce(merge(F.get(a, F.size(a) - 1), v), v)))
        return F.aggregate(x, none, more)

    def over_blocks(blocks: Column) -> Column:
        return let(scan(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1))), lambda ends: F.flatten(F.transform(blocks, lambda b, i: let(F.get(ends, i - 1), lambda start: F.transform(b, lambda v: F.coalesce(merge(start, v), v))))))

    def in_blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: scan(F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))

    whole = let(values, lambda x: F.when(F.size(x) > 0, let(in_blocks(x), over_blocks)).otherwise(none))
    return F.coalesce(whole, none)


def total(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def pieces(text: Column) -> Column:
    """A text in pieces of ``PIECE`` characters, so that a place in it is found without walking there."""
    return F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % PIECE), F.lit(0))


def part(parts: Column, a: Column, b: Column) -> Column:
    """Characters a to b of a text in pieces; nothing if b isn't beyond a."""
    first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
    some = F.array_join(F.slice(parts, first + 1, F.greatest(F.lit(0), last - first + 1)), "")
    return F.when(b > a, F.substring(some, a - first * PIECE + 1, b - a)).otherwise("")


def context_score(kind: str, parts: Column, start: Column, end: Column) -> Column:
    """Score of a span after the words next to it, 0 to 1."""
    alone, more, less = CONTEXT[kind]
    near = F.lower(F.concat(part(parts, F.greatest(start - NEAR, F.lit(0)), start), F.lit(" "), part(parts, end, end + NEAR // 2)))
    score = F.lit(alone) + F.when(near.rlike(rf"\b(?:{more})\b"), STEP).otherwise(0.0) - F.when(near.rlike(rf"\b(?:{less})\b"), STEP).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


SPAN = "array<struct<start:int,kind_no:int,end:int,score:double>>"


def spans_of(kind: str, matches: Column, text: Column, parts: Column) -> Column:
    """Array of (start, kind_no, end, score) of the valid matches of one kind."""
    no = KINDS.index(kind)
    gaps = F.slice(F.split(text, PATTERNS[kind][1], -1), F.lit(1), F.size(matches))  # and one more after the last match
    ends = total(F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m)))
    found = F.zip_with(matches, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), valid(kind, m).alias("ok")))
    scored = F.transform(
        F.filter(found, lambda s: s["ok"]),
        lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), context_score(kind, parts, s["start"], s["end"]).alias("score")),
    )
    if no >= BASE:
        scored = F.filter(scored, lambda s: s["score"] >= LEAST)
    return F.when(F.size(matches) > 0, scored).otherwise(F.expr("array()")).cast(SPAN)


def with_spans(docs: DataFrame, column: str = "spans", keep_parts: bool = False) -> DataFrame:
    """``docs`` with an array of all spans (start, kind_no, end, score), by start, then kind.

    Columns whose names begin with ``_pii_`` are used inside.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    names = {k: f"_pii_{k}" for k in KINDS}
    found = {}
    for k, (must, pattern) in PATTERNS.items():
        m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found[names[k]] = F.when(F.contains(text, F.lit(must)), m).otherwise(F.expr("cast(array() as array<string>)")) if must else m
    docs = docs.withColumns(found)
    some = F.greatest(*[F.size(n) for n in names.values()]) > 0
    docs = docs.withColumn("_pii_parts", F.when(some, pieces(text)).otherwise(F.expr("cast(array() as array<string>)")))
    docs = docs.withColumns({n: spans_of(k, F.col(n), text, F.col("_pii_parts")) for k, n in names.items()})
    docs = docs.withColumn(column, F.array_sort(F.concat(*map(F.col, names.values())))).drop(*names.values())
    return docs if keep_parts else docs.drop("_pii_parts")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets; n_chars follows."""
    columns = docs.columns
    docs = with_spans(docs, "_pii_spans", keep_parts=True)
    text, spans, parts = F.col("text"), F.col("_pii_spans"), F.col("_pii_parts")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    docs = docs.withColumn("_pii_reach", running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.when(a > b, a).otherwise(b)))  # where the masked union ends so far
    reach = F.col("_pii_reach")
    before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
    masked = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(part(parts, before(i), s["start"]), F.get(names, s["kind_no"]))).otherwise(""))
    clean = F.concat(F.array_join(masked, ""), part(parts, before(F.size(spans)), F.length(text)))
    docs = docs.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(text))
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return docs.select(*columns)


def pii(docs: DataFrame) -> DataFrame:
    """Counts by base kind, digest of the base spans, all spans, their number and their scores."""
    docs = with_spans(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind_no"] < BASE)
    count = lambda no: F.size(F.filter("spans", lambda s: s["kind_no"] == no)).cast("long")
    return docs.select(
        "doc_id", *[count(no).alias(f"n_{k}") for no, k in enumerate(KINDS[:BASE])],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"),
        F.transform("spans", lambda s: F.round(s["score"], 2)).alias("scores"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(documents(spark, sf_dir)).drop("scores")


QUERIES = {"op10_pii": op10_pii}


def _oracle() -> str:
    """DuckDB SQL with the plain patterns; IBANs and numbers next to context words don't occur without them."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        "dni": r"\b[0-9]{8}-?[A-Z]\b",
        "nir": r"\b[12]\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}\b",
        "secret": r"[A-Za-z0-9+/_-]{20,}=*",
    }

    def near(kind: str, only: bool) -> str:
        around = f"lower(t[greatest(s - {NEAR}, 0) + 1 : s] || ' ' || t[e + 1 : e + {NEAR // 2}])"
        more, less = (rf"regexp_matches({around}, '\b(?:{CONTEXT[kind][i]})\b')" for i in (1, 2))
        return f"{more} AND NOT {less}" if only else f"({more} OR NOT {less})"

    dig = "regexp_replace(m, '[^0-9]', '', 'g')"
    iban = "replace(m, ' ', '')"
    ok = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) <= 3 AND coalesce(try_cast('0' || right(ltrim(p, '0'), 3) AS INT), 0) <= 255)) = 4",
        "card": f"len({dig}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len({dig}) + 1), lambda i: "
        f"CASE WHEN i % 2 = 1 THEN reverse({dig})[i]::INT WHEN reverse({dig})[i]::INT > 4 THEN reverse({dig})[i]::INT * 2 - 9 ELSE reverse({dig})[i]::INT * 2 END)) % 10 = 0",
        "phone": f"len({dig}) BETWEEN 9 AND 15",
        "iban": f"list_reduce(list_transform(string_split({iban}[5:] || {iban}[:4], ''), lambda c: CASE WHEN c < 'A' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, c: (CASE WHEN c > 9 THEN a * 100 ELSE a * 10 END + c) % 97) % 97 = 1",
        "ssn": near("ssn", True),
        "dni": f"'{DNI_LETTERS}'[m[1:8]::INT % 23 + 1] = m[-1] AND {near('dni', True)}",
        "nir": f"{iban}[1:13]::BIGINT % 97 + {iban}[14:15]::INT = 97 AND {near('nir', False)}",
        "secret": f"regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND len(list_distinct(string_split(m, ''))) >= {VARIETY} AND {near('secret', True)}",
    }
    parts = []
    for no, k in enumerate(KINDS):
        parts.append(f"""
  SELECT r, {no} AS no, '{k}' AS kind, s, e FROM (
    SELECT r, t, m, s, s + len(m) AS e FROM (
      SELECT r, t, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i:
        (list_sum(list_transform(gs[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: len(x))), 0))::BIGINT)) AS s
      FROM (SELECT r, t, regexp_extract_all(t, '{plain[k]}') AS ms, string_split_regex(t, '{plain[k]}') AS gs FROM d)))
  WHERE {ok[k]}""")
    counts = ", ".join(f"count(*) FILTER (no = {no})::BIGINT AS n_{k}" for no, k in enumerate(KINDS[:BASE]))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({" UNION ALL ".join(parts)}),
g AS (SELECT r, {counts},
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (no < {BASE}), '') AS base,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no), '') AS spans, count(*) AS n_spans FROM x GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS[:BASE])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM d LEFT JOIN g USING (r)"""


ORACLES = {"op10_pii": _oracle()}
