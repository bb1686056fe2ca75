"""Personal data in whole texts, with DataFrame functions only.

Regular expressions propose spans; validators confirm them (Luhn for cards, mod-97 for IBANs, ranges for addresses, digit
counts for phone numbers); words near a span adjust its score. Quantifiers are possessive and starts are anchored to the
beginning of a run, which leaves the matches as they are but keeps long runs linear and off the regex engine's stack.

Positions: ``split`` by the same expression gives the gaps between matches, and the running sum of the lengths of gaps and
matches gives each start, in code points. The sum is taken by doubling steps, so a text with n matches costs n log n. The
words near a span are those in the gaps next to it, up to ``NEAR`` code points on either side.

Base kinds (email, ip, card, phone) are kept whatever their score; kinds that the method adds (iban, ssn, mac, secret) need
``least_score``. A secret is a named value of eight characters or more, quoted or not, with letters and digits, or a key of a
known form (private key headers, cloud and code-host keys, signed web tokens).

Defined cases: a null text is empty and has no spans (``redact`` leaves it null); null or repeated ids are rows like any other,
each with its own spans; other columns are ignored by ``find_spans`` and kept by ``redact``; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh

_LOCAL = "A-Za-z0-9._%+-"
#: kind: (pattern, words that raise the score nearby)
KINDS = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "mail|contact|courriel|correo"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "ip|host|server|address|adresse"),
    "card": (r"[0-9](?:[ -]?[0-9])++", "card|visa|credit|karte|carte|tarjeta|pay"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "phone|tel|call|mobile|fax|whatsapp"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "iban|account|konto|compte|cuenta|bank"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "ssn|social|security|tax"),
    "mac": (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])", "mac|device|wifi|hardware"),
    "secret": (
        r"(?i:(?:token|secret|passw(?:or)?d|pwd|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3})(?:\"[^\"\s]{8,}+\"|'[^'\s]{8,}+'|[A-Za-z0-9_./+=-]{8,}+)"
        r"|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])"
        r"|-----BEGIN (?:[A-Z]{1,12} ){0,2}PRIVATE KEY-----",
        "token|secret|password|key",
    ),
}
BASE = ("email", "ip", "card", "phone")
SPAN = "struct<kind:string,start:int,end:int,score:double>"
NEAR = 40


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """Whether the letters and digits of ``m``, first four moved to the end and letters as numbers, leave 1 modulo 97."""
    plain = F.regexp_replace(m, " ", "")
    chars = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        number = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(c == "", rest).otherwise((rest * F.when(number < 10, F.lit(10)).otherwise(F.lit(100)) + number) % 97)

    return (F.length(plain) >= 15) & (F.aggregate(chars, F.lit(0), step) == 1)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", F.when(F.length(_digits(m)) <= 19, _digits(m)).otherwise("1"))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return _mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    if kind == "secret":
        return m.rlike("^(?:-----|AKIA|gh[pousr]_|eyJ)") | (m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike(r"[=:][ \t]*[\"']?(?:[A-Za-z]+|[0-9]+)[\"']?$"))
    return F.lit(True)


def _running(x: Column, over) -> Column:
    """``x[0]``, ``over(x[0], x[1])``, ... of an array<int>: each step of the loop reaches twice as far back as the one before."""

    def step(acc: Column, s: Column) -> Column:
        back = F.concat(F.slice(acc, F.lit(1), s), F.slice(acc, F.lit(1), F.size(acc) - s))  # the first ones have nothing so far back
        far = F.zip_with(F.sequence(F.lit(0), F.size(acc) - 1), F.zip_with(acc, back, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda i, p: F.when(i >= s, over(p["a"], p["b"])).otherwise(p["a"]))
        return F.when(F.size(acc) > s, far.cast("array<int>")).otherwise(acc)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(30))), x.cast("array<int>"), step)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used within lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(kind: str, text: Column, found: Column, least_score: float) -> Column:
    pattern, near = KINDS[kind]
    base = {"iban": 0.8, "card": 0.7, "secret": 0.7, "email": 0.8, "ip": 0.6, "phone": 0.6, "ssn": 0.4, "mac": 0.5}[kind]
    gaps = F.split(text, pattern, -1)
    each = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("left"), m.alias("m"), (F.length(g) + F.length(m)).alias("n")))
    each = F.zip_with(each, F.slice(gaps, F.lit(2), F.size(found)), lambda x, g: F.struct(x.alias("x"), g.alias("right")))
    ends = lambda e: _running(F.transform(e, lambda y: y["x"]["n"]), lambda a, b: a + b)

    def placed(y: Column, end: Column) -> Column:
        m = y["x"]["m"]
        around = F.lower(F.concat_ws(" ", F.substring(y["x"]["left"], -NEAR, NEAR), F.substring(y["right"], 1, NEAR)))
        score = F.lit(base) + F.when(around.rlike(rf"\b(?:{near})"), F.lit(0.2)).otherwise(F.lit(0.0))
        if kind == "secret":
            score = score + F.when(F.lower(m).rlike(rf"^(?:{near})|^-----"), F.lit(0.1)).otherwise(F.lit(0.0))
        span = F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), F.round(score, 3).alias("score"))
        return F.when(_valid(kind, m), span)

    out = F.filter(_once(each, lambda e: F.zip_with(e, ends(e), placed)), lambda s: s.isNotNull())
    if kind not in BASE:
        out = F.filter(out, lambda s: s["score"] >= least_score)
    return F.when(F.size(found) > 0, out).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_spans(docs: DataFrame, name: str, least_score: float = 0.5) -> DataFrame:
    """``docs`` and ``name``: array<struct<kind, start, end, score>> by start, then kind as listed in ``KINDS``."""
    text, *rest = fresh(docs.columns, "text", *(f"m_{k}" for k in KINDS), *(f"s_{k}" for k in KINDS))
    matches, spans = dict(zip(KINDS, rest, strict=False)), dict(zip(KINDS, rest[len(KINDS) :], strict=True))
    rows = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    none = F.array().cast("array<string>")
    digit = F.col(text).rlike("[0-9]")
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "mac": F.contains(text, F.lit(":")), "secret": F.lit(True)}
    rows = rows.withColumns({matches[k]: F.when(hint.get(k, digit), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, (p, _) in KINDS.items()})
    rows = rows.withColumns({spans[k]: _spans(k, F.col(text), F.col(matches[k]), least_score) for k in KINDS})

    def numbered(i: int, kind: str) -> Column:
        return F.transform(spans[kind], lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), s.alias("s")))

    every = F.concat(*(numbered(i, k) for i, k in enumerate(KINDS)))
    return rows.withColumn(name, F.transform(F.array_sort(every), lambda x: x["s"])).drop(text, *rest)


def find_spans(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """(doc_id, spans): spans array<struct<kind, start, end, score>> by start, then kind as listed in ``KINDS``."""
    return with_spans(docs.select("doc_id", "text"), "spans", least_score).select("doc_id", "spans")


def written_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """``docs`` with each personal span of each row's text replaced by [KIND]; overlapping ones are replaced together, named by the first."""
    (name,) = fresh(docs.columns, "spans")
    rows = with_spans(docs, name, least_score)
    held = F.struct(F.split(F.col("text").cast("string"), "").alias("chars"), F.col(name).alias("spans"), _running(F.transform(name, lambda s: s["end"]), F.greatest).alias("upto"))

    def rewritten(x: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            begin = F.when(i > 0, F.get(x["upto"], i - 1)).otherwise(F.lit(0))
            before = F.array_join(F.slice(x["chars"], begin + 1, F.greatest(s["start"] - begin, F.lit(0))), "")
            return F.when(s["start"] >= begin, F.concat(before, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        last = F.element_at(x["upto"], -1)
        tail = F.array_join(F.slice(x["chars"], last + 1, F.greatest(F.size(x["chars"]) - last, F.lit(0))), "")
        return F.concat(F.array_join(F.transform(x["spans"], piece), ""), tail)

    return rows.withColumn("text", F.when(F.size(name) > 0, _once(held, rewritten)).otherwise(F.col("text"))).select(docs.columns)


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(written_spans(base), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
