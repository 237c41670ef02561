"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for international
account numbers), and words near a span, on either side, raise its score. What has no checksum of its
own, as a plain account number, counts only with such a word. Positions come from splitting a text at the matches:
the lengths of the parts between them add up to where each match begins, in code points.

The expressions below find what the plain ones in the comments find, leftmost and not overlapping,
but in time linear in the text: a match can only begin where a run of its characters begins or the
last match ended, and runs are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.names import fresh_name

KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "account")
#: Java forms of: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+),
#: card [0-9]([\x20-]?[0-9])+, phone \+[0-9][\x20().0-9-]+[0-9]; iban in one piece or in groups of four; account a number of 8 to 12 digits.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9_])",
    "account": r"(?<![A-Za-z0-9_])[0-9]{8,12}(?![A-Za-z0-9_])",
}
#: What a text must hold for its expression to be tried at all.
GATES = {"email": "@", "phone": "+"}
DIGIT = "[0-9]"
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Words of which one must stand whole within CONTEXT_CHARS characters before or after a span.
CONTEXT = {
    "email": "mail|email|contact|write|address",
    "ip": "ip|server|host|address|login",
    "card": "card|credit|debit|visa|payment|pay",
    "phone": "phone|telephone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer|konto",
    "account": "account|acct|konto|compte|cuenta",
}
BASE_SCORE = {"email": 0.6, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7, "account": 0.3}
CONTEXT_SCORE = 0.3
CONTEXT_CHARS = 40
#: Added kinds count from this score on; the base kinds always do.
LEAST_SCORE = 0.5


def context_pattern(kind: str) -> str:
    """A word of the kind between borders: anything but ASCII letters, digits and _, or an end of what is looked at."""
    return f"(?:^|[^a-z0-9_])(?:{CONTEXT[kind]})(?:[^a-z0-9_]|$)"


SPAN = "struct<s:int,e:int,t:string>"


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return (F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0)


def mod97(text: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters moved to the end."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        value = F.ascii(c)
        return F.when(value >= 65, (rest * 100 + value - 55) % 97).otherwise((rest * 10 + value - 48) % 97)

    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


VALID = {
    "email": lambda t: F.lit(True),
    "ip": lambda t: t.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"),
    "card": lambda t: F.length(_digits(t)).between(16, 19) & luhn(_digits(t)),
    "phone": lambda t: F.length(_digits(t)).between(8, 15),
    "iban": lambda t: F.length(F.replace(t, F.lit(" "), F.lit(""))).between(15, 34) & mod97(t),
    "account": lambda t: F.lit(True),
}


def _spans(kind: str, matches: Column, lengths: Column) -> Column:
    """Matches and the lengths of the parts between them, as spans that pass the kind's check."""

    def place(state: Column, i: Column) -> Column:
        t = F.get(matches, i)
        s = state["pos"] + F.get(lengths, i)
        e = s + F.length(t)
        # Only what passes is kept, so texts with very many matches that fail take linear time.
        grown = F.concat(state["out"], F.array(F.struct(s.alias("s"), e.alias("e"), t.alias("t"))))
        return F.struct(e.alias("pos"), F.when(VALID[kind](t), grown).otherwise(state["out"]).alias("out"))

    empty = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("pos"), empty.alias("out"))
    placed = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, place, lambda state: state["out"])
    return F.when(F.size(matches) > 0, placed).otherwise(empty)


def find_spans(docs: DataFrame, text_col: str = "text", into: str = "pii_spans") -> DataFrame:
    """docs with one more column: an array of (kind, s, e, score), by kind as listed and then start.

    A null or empty text has none. Every other column and row stays as it is; a column named `into` is
    replaced. A base kind's span always counts; an added kind's counts from LEAST_SCORE on.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = (*KINDS, *ADDED_KINDS)
    own = fresh_name(docs, "pii")
    tmp = lambda kind, what: f"{own}_{kind}_{what}"
    none = F.array().cast("array<string>")
    out = docs.withColumns({tmp(k, "m"): F.when(F.contains(text, F.lit(GATES[k])) if k in GATES else text.rlike(DIGIT), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in kinds})
    out = out.withColumns({tmp(k, "p"): F.when(F.size(tmp(k, "m")) > 0, F.transform(F.split(text, PATTERNS[k], -1), F.length)) for k in kinds})
    out = out.withColumns({tmp(k, "s"): _spans(k, F.col(tmp(k, "m")), F.col(tmp(k, "p"))) for k in kinds})

    def scored(kind: str) -> Column:
        def score(x: Column) -> Column:
            begin = F.greatest(x["s"] - CONTEXT_CHARS, F.lit(0))
            sides = (F.substr(text, begin + 1, x["s"] - begin), F.substr(text, x["e"] + 1, F.lit(CONTEXT_CHARS)))
            near = F.lower(sides[0]).rlike(context_pattern(kind)) | F.lower(sides[1]).rlike(context_pattern(kind))
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), (F.lit(BASE_SCORE[kind]) + F.when(near, CONTEXT_SCORE).otherwise(0.0)).alias("score"))

        spans = F.transform(F.col(tmp(kind, "s")), score)
        return spans if kind in KINDS else F.filter(spans, lambda x: x["score"] >= LEAST_SCORE)

    out = out.withColumn(into, F.concat(*[scored(k) for k in kinds]))
    return out.drop(*[tmp(k, w) for k in kinds for w in "mps"])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by base kind, a digest of the base spans, all spans as a string, and the highest score (null without spans)."""
    found = find_spans(docs.select(id_col, text_col), text_col, "pii_spans")
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda x: x["kind"].isin(*KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in (*KINDS, *ADDED_KINDS)]
    return found.select(id_col, *counts[: len(KINDS)], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), *counts[len(KINDS) :], F.array_max(F.transform(spans, lambda x: x["score"])).alias("top_score"))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span in text_col replaced by its kind in square brackets; of spans that overlap,
    the one that begins first gives the kind and all their characters go. Null texts stay null."""
    found = find_spans(docs, text_col, into := fresh_name(docs, "spans"))
    text = F.col(text_col)
    order = F.array_sort(F.transform(into, lambda x: F.struct(x["s"], x["e"], x["kind"])))

    def cut(state: Column, x: Column) -> Column:
        fresh = x["s"] >= state["pos"]
        parts = F.array(F.substr(text, state["pos"] + 1, x["s"] - state["pos"]), F.concat(F.lit("["), x["kind"], F.lit("]")))
        return F.struct(F.greatest(state["pos"], x["e"]).alias("pos"), F.when(fresh, F.concat(state["out"], parts)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    built = F.aggregate(order, start, cut, lambda state: F.concat(F.array_join(state["out"], ""), F.substr(text, state["pos"] + 1)))
    return found.withColumn(text_col, F.when(F.size(into) > 0, built).otherwise(text)).select(*docs.columns)
