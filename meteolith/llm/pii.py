"""Personal data: generators propose spans, boosted trees choose among them; DataFrame and SQL functions only.

Base spans follow fixed formats with fixed checks and always stay. Beyond them, high-recall generators propose
overlapping spans (written-out addresses, numbers without a country code, other separators, IPv6). Format and context
features of each go through boosted trees, whose calibrated probability must reach the kind's threshold; of
overlapping survivors the likeliest stays, and none overlaps a base span.

No table labels personal data, so the trees are fitted on generated examples in context (TRAINING texts, a seeded and
bounded set), with the very expressions that are later applied; fitting happens on the driver, applying is SQL.

Defined edge cases: null and empty texts have no spans; very long texts are read in linear time (possessive patterns,
starts only at the beginning of a run of a pattern's characters); null or repeated ids keep their rows; columns that
clash with a result column are replaced.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boost, common

KINDS = ("email", "ip", "card", "phone")
#: Base formats. They match what the plain formats match, leftmost and without overlap, but in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9])++",
}
#: High-recall generators.
PROPOSED = {
    "email": [
        r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}| at |@) ?[a-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[a-z0-9-]{2,63}+){1,5}+",
    ],
    "ip": [
        r"(?i)(?<![0-9a-z:.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]) ?[0-9]{1,3}){3}(?![0-9a-z])",
        r"(?i)(?<![0-9a-z:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-z:])",
    ],
    "card": [
        r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ._/-][0-9]{4}){3}(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9A-Za-z])",
    ],
    "phone": [
        r"(?<![0-9A-Za-z.,/-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z.,/-])00[0-9]{1,3}(?:[ ./-]?[0-9]{2,4}){3,5}(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z.,/-])0[0-9]{2,4}[ /-][0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9A-Za-z])",
    ],
}
#: Words before a span that speak for its kind.
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|correo|courriel|kontakt|escrib)",
    "ip": r"(?i)(?:\bip\b|\bips\b|addr|host|server|login|adresse|direcci)",
    "card": r"(?i)(?:card|visa|master|amex|credit|pay|karte|tarjeta|carte)",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|ring|anruf|llam|appel)",
}
#: Words before a number that speak against personal data.
AGAINST = r"(?i)(?:order|invoice|version|serial|isbn|part|ref|id|no\.|batch|build|ticket|token|hash|code)\W*$"
CONTEXT = 30
#: Matches whose offsets are added up in one go.
STRETCH = 128
#: Precision that thresholds keep on examples not used for growing trees.
PRECISION = 0.99
SPAN_LIST = "array<struct<start:int,end:int,s:string,before:string>>"
NONE = f"cast(array() as {SPAN_LIST})"
FEATURES = ["f_len", "f_digits", "f_seps", "f_parens", "f_luhn", "f_same", "f_cue", "f_against", "f_word", "f_form", "f_tail", "f_zero"]


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def found(text: str, pattern: str) -> str:
    """SQL: all matches as array<struct<start, end, s, before>>, in code points; text is an SQL expression of a column,
    before are up to CONTEXT characters ahead of the match (from the stretch it is in).

    What stands between the matches (split) and the matches alternate, so their lengths add up to the offsets. An array
    is copied with each element that is added, so offsets are made within stretches of STRETCH matches and then moved."""
    p = _quoted(pattern)
    gap, match = "b.g[i - 1]", "b.m[i - 1]"
    before = f"right(concat(a.tail, {gap}), {CONTEXT})"
    near = f"""aggregate(sequence(1, size(b.m)), named_struct('at', 0, 'tail', '', 'out', {NONE}),
            (a, i) -> named_struct('at', a.at + length({gap}) + length({match}), 'tail', right(concat({before}, {match}), {CONTEXT}), 'out', concat(a.out, array(named_struct(
                'start', a.at + length({gap}), 'end', a.at + length({gap}) + length({match}), 's', {match}, 'before', {before})))))"""
    stretches = f"""transform(transform(sequence(0, (size(x.m) - 1) div {STRETCH}),
            i -> named_struct('m', slice(x.m, i * {STRETCH} + 1, {STRETCH}), 'g', slice(x.g, i * {STRETCH} + 1, {STRETCH}))), b -> {near})"""
    moved = "transform(b.out, y -> named_struct('start', y.start + a.at, 'end', y.end + a.at, 's', y.s, 'before', y.before))"
    return f"""CASE WHEN {text} RLIKE {p} THEN flatten(transform(array(named_struct('m', regexp_extract_all({text}, {p}, 0), 'g', split({text}, {p}, -1))),
        x -> aggregate({stretches}, named_struct('at', 0, 'out', cast(array() as array<{SPAN_LIST}>)),
            (a, b) -> named_struct('at', a.at + b.at, 'out', concat(a.out, array({moved}))), a -> flatten(a.out)))) ELSE {NONE} END"""


def luhn(digits: str) -> str:
    """SQL: whether a string of digits passes Luhn's check."""
    return f"""aggregate(sequence(1, length({digits})), 0, (t, i) -> t + CASE WHEN i % 2 = 1 THEN int(substr(reverse({digits}), i, 1))
        WHEN int(substr(reverse({digits}), i, 1)) > 4 THEN 2 * int(substr(reverse({digits}), i, 1)) - 9
        ELSE 2 * int(substr(reverse({digits}), i, 1)) END) % 10 = 0"""


_DIGITS = "regexp_replace(x.s, '[^0-9]', '')"
CHECKS = {
    "email": "true",
    "ip": r"forall(split(x.s, r'\.'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND {luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """df with __base: array<struct<kind (place in KINDS), start, end>>, sorted."""
    kinds = [f"transform(filter({found(text, BASE[k])}, x -> {CHECKS[k]}), x -> named_struct('kind', {i}, 'start', x.start, 'end', x.end))" for i, k in enumerate(KINDS)]
    return df.withColumn("__base", F.expr(f"concat({', '.join(kinds)})"))


def proposals(df: DataFrame, text: str) -> DataFrame:
    """df with __proposed: array of spans with kind, text and features."""
    parts = []
    for i, k in enumerate(KINDS):
        for pattern in PROPOSED[k]:
            parts.append(f"transform({found(text, pattern)}, x -> {_features(k, i)})")
    kind = "array<struct<kind:int,start:int,end:int," + ",".join(f"{f}:double" for f in FEATURES) + ">>"
    return df.withColumn("__proposed", F.expr(f"cast(concat({', '.join(parts)}) as {kind})"))


def _features(k: str, i: int) -> str:
    d = _DIGITS
    values = {
        "f_len": "length(x.s)",
        "f_digits": f"length({d})",
        "f_seps": "length(regexp_replace(x.s, r'[A-Za-z0-9]', ''))",
        "f_parens": r"length(regexp_replace(x.s, r'[^()\[\]{}@]', ''))",
        "f_luhn": f"CASE WHEN length({d}) BETWEEN 13 AND 19 AND {luhn(d)} THEN 1 ELSE 0 END",
        "f_same": f"CASE WHEN length({d}) > 0 THEN size(array_distinct(split({d}, ''))) ELSE 0 END",
        "f_cue": f"CASE WHEN x.before RLIKE {_quoted(CUES[k])} THEN 1 ELSE 0 END",
        "f_against": f"CASE WHEN x.before RLIKE {_quoted(AGAINST)} THEN 1 ELSE 0 END",
        "f_word": "CASE WHEN x.before RLIKE r'[A-Za-z0-9]$' THEN 1 ELSE 0 END",
        "f_form": r"size(split(x.s, r'(?i)\(dot\)|\[dot\]|\{dot\}| dot |\.|:| |-|/'))",
        "f_tail": r"length(regexp_extract(x.s, r'([A-Za-z]+)$', 1))",
        "f_zero": "CASE WHEN x.s RLIKE r'^\\(?0' THEN 1 ELSE 0 END",
    }
    return f"named_struct('kind', {i}, 'start', x.start, 'end', x.end, " + ", ".join(f"'{f}', double({values[f]})" for f in FEATURES) + ")"


def training(n: int = 160, seed: int = 17) -> list[tuple[str, int, str]]:
    """(text, label, kind): generated spans in context; label 1 is personal data."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "tion", "lo", "mi", "st", "ea", "ko", "ve", "ra"]) for _ in range(r.randint(1, 4)))
    dig = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    some = lambda: " ".join(word() for _ in range(r.randint(2, 5)))

    def card(k: int) -> str:
        body = ("37" if k == 15 else r.choice("45")) + dig(k - 2 - (k == 15) + (0 if k == 15 else 0))
        body = body[: k - 1]
        total = sum(int(c) if i % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    four = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, len(s), 4))
    out = []
    for _ in range(n):
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", " (dot) "), ("{at}", "."), (" [at] ", ".")])
        tld = r.choice(["com", "org", "net", "de", "fr", "es", "io", "info"])
        out.append((f"{some()} {r.choice(['mail', 'contact me', 'write to', word(), 'reach'])} {word()}{at}{word()}{dot}{tld} {some()}", 1, "email"))
        out.append((f"{some()} {word()} at {word()}. {word()} {some()}", 0, "email"))
        out.append((f"{some()} {word()} @ {word()}. {word()}{word()} {some()}", 0, "email"))
        ip = [str(r.randint(0, 255)) for _ in range(4)]
        out.append((f"{some()} {r.choice(['host', 'ip', 'server', word()])} {r.choice(['[.]', '(.)', '[dot]']).join(ip)} {some()}", 1, "ip"))
        out.append((f"{some()} {r.choice(['host', 'ip', word()])} {':'.join('%x' % r.randint(0, 65535) for _ in range(8))} {some()}", 1, "ip"))
        out.append((f"{some()} {r.choice(['version', 'hash', 'id'])} {':'.join('%02x' % r.randint(0, 255) for _ in range(8))} {some()}", 0, "ip"))
        s = card(16)
        out.append((f"{some()} {r.choice(['card', 'visa', 'pay', word()])} {four(s, r.choice('._/'))} {some()}", 1, "card"))
        s = card(15)
        out.append((f"{some()} {r.choice(['amex', 'card', word()])} {r.choice([s, s[:4] + ' ' + s[4:10] + ' ' + s[10:]])} {some()}", 1, "card"))
        s = dig(15) + str((int(card(16)[-1]) + 1) % 10)
        out.append((f"{some()} {r.choice(['serial', 'order', 'code', word()])} {four(s, r.choice('._/-'))} {some()}", 0, "card"))
        out.append((f"{some()} {r.choice(['serial', 'order', word()])} 37{dig(13)} {some()}", 0, "card"))
        sep = r.choice(" .-")
        out.append((f"{some()} {r.choice(['call', 'phone', 'tel', 'fax'])} {r.choice([f'({dig(3)}) {dig(3)}-{dig(4)}', sep.join([dig(3), dig(3), dig(4)]), f'0{dig(3)} {dig(3)} {dig(3)}', f'0049 {dig(3)} {dig(3)} {dig(3)}'])} {some()}", 1, "phone"))
        out.append((f"{some()} {word()} ({dig(3)}) {dig(3)}-{dig(4)} {some()}", 1, "phone"))
        out.append((f"{some()} {r.choice(['order', 'serial', 'invoice', 'part', 'build'])} {sep.join([dig(3), dig(3), dig(4)])} {some()}", 0, "phone"))
        out.append((f"{some()} {word()} {' '.join([dig(3), dig(3), dig(4)])} {some()}", 0, "phone"))
        out.append((f"{some()} {r.choice(['id', 'code', 'ref'])} 0{dig(3)}-{dig(3)}{dig(3)} {some()}", 0, "phone"))
    return out


_MODELS: dict[int, list[tuple[boost.Boosted, float]]] = {}


def models(spark: SparkSession) -> list[tuple[boost.Boosted, float]]:
    """For each kind its trees and the least probability whose precision is PRECISION on the examples that grew none."""
    if 0 not in _MODELS:
        rows = spark.createDataFrame(training(), "text string, label int, k string")
        got = proposals(rows, "text").select("label", "k", F.explode("__proposed").alias("p")).select("label", "k", "p.*").collect()
        out = []
        for i, k in enumerate(KINDS):
            own = [r for r in got if r["kind"] == i]
            x, y = np.array([[r[f] for f in FEATURES] for r in own]), np.array([r["label"] if r["k"] == k else 0 for r in own])
            model = boost.fit(x, y)
            y, p = y[model.held], model.probability(x[model.held])
            order = np.argsort(-p, kind="stable")
            precise = np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= PRECISION
            # Whole ties only, and never below one half.
            cut = [p[order[j]] for j in range(len(y)) if precise[j] and (j + 1 == len(y) or p[order[j + 1]] < p[order[j]])]
            out.append((model, max(0.5, float(min(cut)) - 1e-9) if cut else 2.0))
        _MODELS[0] = out
    return _MODELS[0]


def personal_data(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with base (sorted base spans) and spans (all spans): array<struct<kind, start, end>>."""
    df = docs.drop("base", "spans").withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    df = proposals(base_spans(df, "__t"), "__t")
    probability = "CASE x.kind " + " ".join(f"WHEN {i} THEN {m.sql(['x.' + f for f in FEATURES])}" for i, (m, _) in enumerate(models(docs.sparkSession))) + " END"
    least = "CASE x.kind " + " ".join(f"WHEN {i} THEN {c:.9f}D" for i, (_, c) in enumerate(models(docs.sparkSession))) + " END"
    # Most proposals in a text with many spans are base spans; those go by hash, only the rest meet every base span.
    code = "shiftleft(bigint(x.start), 31) + x.end"
    df = df.withColumn("__rest", F.expr(f"array_except(transform(__proposed, x -> {code}), transform(__base, x -> {code}))"))
    df = df.withColumn("__proposed", F.expr(f"CASE WHEN size(__rest) = 0 THEN slice(__proposed, 1, 0) ELSE filter(__proposed, x -> array_contains(__rest, {code})) END"))
    df = df.withColumn("__scored", F.expr(f"transform(filter(__proposed, x -> NOT exists(__base, b -> b.start < x.end AND x.start < b.end)), x -> named_struct('p', {probability}, 'least', {least}, 'kind', x.kind, 'start', x.start, 'end', x.end))"))
    df = df.withColumn("__likely", F.expr("array_distinct(filter(__scored, x -> x.p >= x.least))"))
    # Likeliest first; a span stays unless it overlaps one that stays, so a beaten span beats nothing.
    by_rank = "array_sort(transform(__likely, x -> named_struct('r', -x.p, 'len', x.start - x.end, 'start', x.start, 'kind', x.kind, 'end', x.end)))"
    free = "NOT exists(a, y -> y.start < x.end AND x.start < y.end)"
    none = "cast(array() as array<struct<kind:int,start:int,end:int>>)"
    df = df.withColumn("__added", F.expr(f"aggregate({by_rank}, {none}, (a, x) -> CASE WHEN {free} THEN concat(a, array(named_struct('kind', x.kind, 'start', x.start, 'end', x.end))) ELSE a END)"))
    df = df.withColumn("base", F.expr("array_sort(__base)")).withColumn("spans", F.expr("array_sort(concat(__base, __added))"))
    return df.drop("__t", "__base", "__proposed", "__rest", "__scored", "__likely", "__added")


def listed(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', array({names})[x.kind], string(x.start), string(x.end))), ',')")


def redact(df: DataFrame, *, text_col: str = "text", spans: str = "spans") -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one.

    Pieces are made within stretches of STRETCH spans, as an array is copied with each element that is added."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    t = f"`{text_col}`"
    by_start = f"array_sort(transform({spans}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))"
    stretches = f"transform(array({by_start}), s -> transform(sequence(0, (size(s) - 1) div {STRETCH}), i -> slice(s, i * {STRETCH} + 1, {STRETCH})))[0]"
    none = "cast(array() as array<string>)"
    one = f"""aggregate(b, named_struct('at', a.at, 'out', {none}),
            (a, x) -> CASE WHEN x.start < a.at THEN named_struct('at', greatest(a.at, x.end), 'out', a.out)
                ELSE named_struct('at', x.end, 'out', concat(a.out, array(substr({t}, a.at + 1, x.start - a.at), array({names})[x.kind]))) END)"""
    return F.expr(f"""CASE WHEN size({spans}) = 0 OR {t} IS NULL THEN {t} ELSE aggregate({stretches},
        named_struct('at', 0, 'out', {none}),
        (a, b) -> transform(array({one}), y -> named_struct('at', y.at, 'out', concat(a.out, array(array_join(y.out, '')))))[0],
        a -> concat(array_join(a.out, ''), substr({t}, a.at + 1))) END""")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = personal_data(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"bigint(size(filter(base, x -> x.kind = {i})))").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return docs.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
