"""Secret scan: strong secrets by pattern, weak parts of credentials by linking them within a scope.

Strong spans stand for themselves: an assigned value (``assign``), an access identifier (``access``), a long hexadecimal run (``hex``).
Weak parts are common in clean text: a named account (``identifier``), an unnamed string of mixed letters and digits
(``candidate``), the address of a service (``endpoint``). They are reported only where complementary parts share a scope, which
is a block of lines without a blank one, or a pair of braces without others inside:

* a candidate beside an access identifier, or beside a named account and an endpoint,
* a named account beside an assigned or hexadecimal secret, or beside a candidate and an endpoint,
* an endpoint beside any identifier and any secret.

One pass over the texts finds spans and scopes. Parts are then joined to the scopes that hold them: an interval join on document
and bins of ``BIN`` code points, so a scope meets only the parts near it; roles are aggregated per scope and joined back to the
weak parts. Only documents that have every role somewhere send parts and scopes, which loses none.

Null text is empty; an empty one has no spans. Rows that repeat an id and a text get the same spans each; ids may be null and of
any type. Weak parts that overlap a strong span are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.llm.common import save, with_arrow

BIN = 1024


def either(word: str) -> str:
    """Pattern of a word of ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + f"|{either('api')}_?{either('key')}"
_GLUE = r"""["']?\x20*[:=]\x20*["']?"""
# Patterns by kind, in the order in which kinds are listed. They mean the same to both regular expression engines in use.
STRONG = {
    "assign": f"({_NAMES}){_GLUE}([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}
_ACCOUNTS = "|".join(either(w) for w in ("client", "account", "tenant", "user", "login"))
WEAK = {
    "identifier": f"({_ACCOUNTS})[_-]?({either('id')}|{either('name')})?{_GLUE}([A-Za-z0-9@._-]+)",
    "candidate": "[A-Za-z0-9+/_-]+",
    "endpoint": r"""([a-z][a-z0-9+]*)://[^\x00-\x20"'<>]+""",
}
KINDS = [*STRONG, *WEAK]
BLANK_LINES = r"\n[\x20\x09\x0D]*\n[\x20\x09\x0D\n]*"
BRACES = r"\{[^{}]*\}"
# Least lengths: of the assigned value, of whole matches, of an account's value.
ASSIGNED, ACCESS, HEX, ACCOUNT, CANDIDATE = 6, 20, 24, 3, 16

_compiled = {k: re.compile(p) for k, p in (STRONG | WEAK).items()}
# the same matches, found without stopping at runs that are too short
_compiled["access"] = re.compile(f"AKIA[A-Z0-9]{{{ACCESS - 4},}}")
_compiled["hex"] = re.compile(f"[0-9a-f]{{{HEX},}}")
_compiled["candidate"] = re.compile(f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{CANDIDATE},}}")
_blank, _braces = re.compile(BLANK_LINES), re.compile(BRACES)
_mixed = [re.compile(p) for p in ("[0-9]", "[a-z]", "[A-Z]")]
Span = tuple[int, int, int]  # place of the kind in KINDS, start, end


def strong_spans(text: str) -> list[Span]:
    """Strong spans in code points, kind after kind."""
    out = [(0, *m.span()) for m in _compiled["assign"].finditer(text) if len(m[2]) >= ASSIGNED]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in _compiled["access"].finditer(text)]
    return out + [(2, *m.span()) for m in _compiled["hex"].finditer(text)]


def weak_spans(text: str, strong: list[Span]) -> list[Span]:
    """Weak parts that overlap no strong span."""
    found = [(3, *m.span()) for m in _compiled["identifier"].finditer(text) if len(m[3]) >= ACCOUNT]
    found += [(4, *m.span()) for m in _compiled["candidate"].finditer(text) if all(p.search(m[0]) for p in _mixed)]
    found += [(5, *m.span()) for m in _compiled["endpoint"].finditer(text)]
    taken, reach = [], -1
    for start, end in sorted(s[1:] for s in strong):
        if start >= reach:
            taken.append([start, end])
        else:
            taken[-1][1] = max(taken[-1][1], end)
        reach = taken[-1][1]
    out, k = [], 0
    for kind, start, end in sorted(found, key=lambda s: s[1:]):
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k == len(taken) or taken[k][0] >= end:
            out.append((kind, start, end))
    return out


def linkable(kinds: set[int]) -> bool:
    """Whether parts of these kinds can make any weak part worth a report."""
    strong_secret, account = bool(kinds & {0, 2}), 3 in kinds
    return (4 in kinds and (1 in kinds or (account and 5 in kinds))) or (account and strong_secret) or (5 in kinds and bool(kinds & {1, 3}) and bool(kinds & {0, 2, 4}))


def scopes(text: str) -> list[tuple[int, int]]:
    """Blocks between blank lines, and pairs of braces."""
    out, begin = [], 0
    for m in _blank.finditer(text):
        out.append((begin, m.start()))
        begin = m.end()
    out.append((begin, len(text)))
    return out + [m.span() for m in _braces.finditer(text)]


def scan(docs: DataFrame) -> DataFrame:
    """Add ``strong`` spans, and for documents that may hold a linked credential ``weak`` spans and ``scopes``."""
    span = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end")]))
    scope = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("from", "to")]))

    def make():
        def rows(texts):
            strong, weak, held = [], [], []
            for text in texts:
                text = text or ""
                sure = strong_spans(text)
                strong.append([dict(zip(("kind", "start", "end"), s)) for s in sure])
                parts = weak_spans(text, sure)
                linked = linkable({s[0] for s in sure} | {s[0] for s in parts})
                weak.append([dict(zip(("kind", "start", "end"), s)) for s in parts] if linked else [])
                held.append([{"from": a, "to": b} for a, b in scopes(text)] if linked else [])
            return [strong, weak, held]

        return rows

    fields = [T.StructField("strong", span), T.StructField("weak", span), T.StructField("scopes", scope)]
    return with_arrow(docs, ["text"], T.StructType(fields), make)


def linked_spans(scanned: DataFrame, width: int = BIN) -> DataFrame:
    """Weak parts with their complements in a scope: doc_id, mark, linked (array of spans). Rows have doc_id, mark and ``scan``'s columns."""
    some = scanned.where(F.size("scopes") > 0).dropDuplicates(["doc_id", "mark"])
    # bins in which a scope lies; a part is looked up in the bin of its start
    within = some.select("doc_id", "mark", F.inline("scopes"))
    within = within.withColumn("bin", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor(F.greatest("from", F.col("to") - 1) / width))))
    parts = some.select("doc_id", "mark", F.inline(F.concat("strong", "weak"))).withColumn("bin", F.floor(F.col("start") / width))
    s, p = within.alias("s"), parts.alias("p")
    near = F.expr("s.doc_id <=> p.doc_id AND s.mark = p.mark AND s.bin = p.bin AND s.`from` <= p.start AND p.`end` <= s.`to`")
    pairs = s.join(p, near).select("p.doc_id", "p.mark", "s.from", "s.to", "p.kind", "p.start", "p.end")
    roles = [F.max((F.col("kind") == k).cast("int")).alias(n) for k, n in enumerate(KINDS)]
    has = pairs.groupBy("doc_id", "mark", "from", "to").agg(*roles).alias("h")
    weak = pairs.where(F.col("kind") >= len(STRONG)).alias("w")
    both = weak.join(has, F.expr("w.doc_id <=> h.doc_id AND w.mark = h.mark AND w.`from` = h.`from` AND w.`to` = h.`to`"))
    report = F.expr(
        "(kind = 4 AND (access = 1 OR (identifier = 1 AND endpoint = 1))) OR (kind = 3 AND (assign = 1 OR hex = 1 OR (candidate = 1 AND endpoint = 1)))"
        " OR (kind = 5 AND (access = 1 OR identifier = 1) AND (assign = 1 OR hex = 1 OR candidate = 1))"
    )
    found = both.where(report).select("w.doc_id", "w.mark", "w.kind", "w.start", "w.end").distinct()
    return found.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))


def listed(spans):
    """Spans as kind:start:end by start, then kind as listed."""
    names = F.lit(KINDS)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per document the strong spans of each kind counted and digested, and all spans with the linked weak parts."""
    given = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark"))
    scanned = save(scan(given).drop("text"), "secrets")
    linked = linked_spans(scanned).select(F.col("doc_id").alias("id"), F.col("mark").alias("of"), "linked")
    joined = scanned.join(linked, F.expr("doc_id <=> id AND mark = of"), "left")
    kinds = F.transform("strong", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{n}") for k, n in enumerate(STRONG)]
    extra = F.coalesce("linked", F.array().cast(scanned.schema["strong"].dataType))
    return joined.select("doc_id", *counts, F.sha2(listed(F.col("strong")), 256).alias("base_sha256"), listed(F.concat("strong", extra)).alias("spans"))


def _places(name: str, pattern: str) -> str:
    """CTE with the places of a pattern's matches: the pieces between the matches and the matches add up to them."""
    quoted = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT r, m, (upto - len(m))::INT AS start, upto::INT AS stop
  FROM (SELECT r, m, sum(len(b) + len(m)) OVER (PARTITION BY r ORDER BY k) AS upto
    FROM (SELECT r, generate_subscripts(ms, 1) AS k, unnest(ms) AS m, unnest(bs[1:len(ms)]) AS b
      FROM (SELECT r, regexp_extract_all(text, '{quoted}') AS ms, regexp_split_to_array(text, '{quoted}') AS bs FROM d))))"""


def _sql() -> str:
    tests = [
        f"len(regexp_extract(m, '{STRONG['assign'].replace(chr(39), chr(39) * 2)}', 2)) >= {ASSIGNED}",
        f"len(m) >= {ACCESS}",
        f"len(m) >= {HEX}",
        f"len(regexp_extract(m, '{WEAK['identifier'].replace(chr(39), chr(39) * 2)}', 3)) >= {ACCOUNT}",
        f"len(m) >= {CANDIDATE} AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')",
        "true",
    ]
    places = ",\n".join(_places(f"m{k}", (STRONG | WEAK)[n]) for k, n in enumerate(KINDS))
    spans = " UNION ALL ".join(f"SELECT r, {k} AS kind, '{n}' AS name, start, stop FROM m{k} WHERE {t}" for k, (n, t) in enumerate(zip(KINDS, tests)))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{places},
found AS ({spans}),
strong AS (SELECT * FROM found WHERE kind < 3),
parts AS (SELECT * FROM found w WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM strong s WHERE s.r = w.r AND s.start < w.stop AND w.start < s.stop)),
{_places("gaps", BLANK_LINES)},
{_places("braces", BRACES)},
blocks AS (
  SELECT r, coalesce(lag(stop) OVER (PARTITION BY r ORDER BY start), 0) AS start, start AS stop
  FROM (SELECT r, start, stop FROM gaps UNION ALL SELECT r, len(text), len(text) FROM d)),
scopes AS (SELECT r, start, stop FROM blocks UNION SELECT r, start, stop FROM braces),
inside AS (SELECT p.*, s.start AS a, s.stop AS b FROM parts p JOIN scopes s ON s.r = p.r AND s.start <= p.start AND p.stop <= s.stop),
roles AS (
  SELECT r, a, b, bool_or(kind = 1) AS access, bool_or(kind IN (0, 2)) AS secret, bool_or(kind = 3) AS account, bool_or(kind = 4) AS candidate, bool_or(kind = 5) AS endpoint
  FROM inside GROUP BY r, a, b),
linked AS (
  SELECT DISTINCT i.r, kind, name, start, stop FROM inside i JOIN roles q ON q.r = i.r AND q.a = i.a AND q.b = i.b
  WHERE (kind = 4 AND (access OR (account AND endpoint))) OR (kind = 3 AND (secret OR (candidate AND endpoint)))
    OR (kind = 5 AND (access OR account) AND (secret OR candidate))),
base AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS listed FROM strong GROUP BY r),
every AS (
  SELECT r, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM (SELECT * FROM strong UNION ALL SELECT * FROM linked) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r)
"""


SQL = _sql()
