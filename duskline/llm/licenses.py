"""License scans: ordered signature rules on the words of a text, by built-in functions alone.

A text becomes its lower-cased words joined by single spaces. A rule is a regular expression over
such words, tried only where its keyword occurs, and texts without any keyword try none. A
detection inside a longer one, or inside an equal one of a rule that comes earlier, is suppressed.
The base phrases are counted apart, and their labels always stay.

Defined cases: a null text is empty, has no words and a score of 0; first_word and last_word are
null without a base phrase, and the label columns empty without labels; repeated rows are scanned
one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# (label, keyword, expression, score), the earlier the stronger among equal intervals.
Rule = tuple[str, str, str, float]


def rules() -> list[Rule]:
    """All rules, made from families of names, versions and ways to write them."""
    out: list[Rule] = []

    def add(label: str, keyword: str, pattern: str, score: float) -> None:
        out.append((label, keyword, pattern, score))

    # Licenses whose versions may be followed by "or later" or "only".
    numbered = [
        ("gpl", "gpl", "general public", "(?:gnu )?(?:gpl|general public licen[cs]e)", ("1", "2", "3")),
        ("lgpl", "lgpl", "lesser", "(?:gnu )?(?:lgpl|lesser general public licen[cs]e)", ("2.1", "3")),
        ("lgpl", "lgpl", "library", "(?:gnu )?(?:lgpl|library general public licen[cs]e)", ("2",)),
        ("agpl", "agpl", "affero", "(?:gnu )?(?:agpl|affero general public licen[cs]e)", ("1", "3")),
        ("gfdl", "gfdl", "free documentation", "(?:gnu )?(?:gfdl|fdl|free documentation licen[cs]e)", ("1.1", "1.2", "1.3")),
        ("mpl", "mpl", "mozilla", "(?:mpl|mozilla public licen[cs]e)", ("1.0", "1.1", "2.0")),
        ("epl", "epl", "eclipse", "(?:epl|eclipse public licen[cs]e)", ("1.0", "2.0")),
        ("eupl", "eupl", "european union", "(?:eupl|european union public licen[cs]e)", ("1.0", "1.1", "1.2")),
        ("cddl", "cddl", "common development", "(?:cddl|common development and distribution licen[cs]e)", ("1.0", "1.1")),
        ("apache", "apache", "apache", "apache(?: software)? licen[cs]e", ("1.0", "1.1", "2.0")),
        ("artistic", "artistic", "artistic", "artistic licen[cs]e", ("1.0", "2.0")),
        ("osl", "osl", "open software", "(?:osl|open software licen[cs]e)", ("1.0", "2.0", "2.1", "3.0")),
        ("afl", "afl", "academic free", "(?:afl|academic free licen[cs]e)", ("1.1", "1.2", "2.0", "2.1", "3.0")),
        ("bsl", "bsl", "boost", "(?:bsl|boost software licen[cs]e)", ("1.0",)),
        ("python", "python", "python", "python(?: software foundation)? licen[cs]e", ("2.0", "2.1", "3.0")),
        ("php", "php", "php", "php licen[cs]e", ("3.0", "3.01")),
        ("ofl", "ofl", "open font", "(?:ofl|open font licen[cs]e)", ("1.0", "1.1")),
    ]
    for family, short, long, name, versions in numbered:
        for version, keyword in product(versions, dict.fromkeys((short, long))):
            digits = version.removesuffix(".0").replace(".", " ")
            number = f"(?: version| v)? ?v?{digits}" + ("(?: 0)?" if " " not in digits else "")
            add(f"{family}-{version}-or-later", keyword, f"{name}{number} or (?:any |at your option any )?(?:later|newer)(?: version)?", 1.0)
            add(f"{family}-{version}-only", keyword, f"{name}{number} only", 1.0)
            add(f"{family}-{version}", keyword, f"{name}{number}", 0.95)
    # Creative Commons: terms and versions.
    terms = [("by", "by", "attribution")]
    terms += [
        (f"by-{'-'.join(c)}", "by " + " ".join(c), "attribution " + " ".join(long[x] for x in c))
        for long in ({"nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s", "sa": "share ?alike"},)
        for c in (("nc",), ("nd",), ("sa",), ("nc", "nd"), ("nc", "sa"))
    ]
    for (term, short, long), version in product(terms, ("1.0", "2.0", "2.5", "3.0", "4.0")):
        digits = version.replace(".", " ")
        add(f"cc-{term}-{version}", "cc by", f"cc {short} (?:version |v)?{digits}", 1.0)
        add(f"cc-{term}-{version}", "creative commons", f"creative commons {long} (?:licen[cs]e )?(?:version |v)?{digits}", 1.0)
    for term, short, long in terms:
        add(f"cc-{term}", "cc by", f"cc {short}", 0.9)
        add(f"cc-{term}", "creative commons", f"creative commons {long}", 0.9)
    add("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 1.0)
    for clause, word in (("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        add(f"bsd-{clause}-clause", "clause", f"(?:bsd {clause} clause|(?:{clause}|{word}) clause bsd)(?: licen[cs]e)?", 1.0)
    plain = [
        ("gpl", "general public", "(?:gnu )?general public licen[cs]e"),
        ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e"),
        ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e"),
        ("apache", "apache", "apache(?: software)? licen[cs]e"),
        ("mit", "mit", "(?:the )?mit licen[cs]e"),
        ("mit", "mit", "licensed under (?:the )?mit"),
        ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
        ("bsd", "bsd", "(?:new |modified |simplified )?bsd(?: style)? licen[cs]e"),
        ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification"),
        ("isc", "isc", "isc licen[cs]e"),
        ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose"),
        ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
        ("unlicense", "unlicense", "(?:the )?unlicense"),
        ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
        ("wtfpl", "wtfpl", "wtfpl"),
        ("mpl", "mozilla", "mozilla public licen[cs]e"),
        ("epl", "eclipse", "eclipse public licen[cs]e"),
        ("public-domain", "public domain", "(?:in|into|to) the public domain"),
        ("proprietary", "all rights", "all rights reserved"),
    ]
    for label, keyword, pattern in plain:
        add(label, keyword, pattern, 0.8)
    return out


def normalized(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _base(padded: Column, phrase: str) -> Column:
    """Places of a phrase, and the first and last word at which it starts."""
    parts = F.split(padded, f"(?<= ){phrase}(?= )", -1)
    size = len(phrase.split())
    found = F.struct(
        (F.size(parts) - 1).cast("long").alias("n"),
        (_spaces(F.get(parts, F.lit(0))) - 1).cast("long").alias("first"),
        (_spaces(padded) - 1 - (_spaces(F.element_at(parts, -1)) - 1) - size).cast("long").alias("last"),
    )
    none = F.struct(F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long"))
    return F.when(F.contains(padded, F.lit(f" {phrase} ")), found).otherwise(none.cast("struct<n:bigint,first:bigint,last:bigint>"))


def _present(padded: Column, signatures: list[Rule]) -> Column:
    """The keywords that occur."""
    keywords = sorted({keyword for _, keyword, _, _ in signatures})
    return F.array_compact(F.array(*[F.when(F.contains(padded, F.lit(k)), F.lit(k)) for k in keywords]))


def _detections(padded: Column, present: Column, signatures: list[Rule]) -> Column:
    """Every place at which a rule matches: (start, stop, rule, label, score)."""
    kind = "array<struct<start:int,stop:int,rule:int,label:string,score:double>>"
    table = F.array(
        *[
            F.struct(
                F.lit(n).alias("rule"),
                F.lit(keyword).alias("keyword"),
                F.lit(f"(?<= )(?:{pattern})(?= )").alias("pattern"),
                F.lit(label).alias("label"),
                F.lit(score).alias("score"),
            )
            for n, (label, keyword, pattern, score) in enumerate(signatures)
        ]
    )

    def spans(rule: Column) -> Column:
        found = F.regexp_extract_all(padded, rule["pattern"], F.lit(0))
        between = F.split(padded, rule["pattern"], -1)
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {kind})").alias("out"))

        def step(state: Column, pair: Column) -> Column:
            begin = state["at"] + F.length(pair["before"])
            stop = begin + F.length(pair["match"])
            span = F.struct(
                begin.alias("start"), stop.alias("stop"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["score"].alias("score")
            )
            return F.struct(stop.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda a, b: F.struct(a.alias("before"), b.alias("match")))
        return F.aggregate(pairs, start, step, lambda state: state["out"])

    tried = F.filter(table, lambda rule: F.array_contains(present, rule["keyword"]))
    return F.when(F.size(present) > 0, F.flatten(F.transform(tried, spans))).otherwise(F.expr(f"cast(array() as {kind})"))


def _surviving(found: Column) -> Column:
    def beaten(a: Column) -> Column:
        def beats(b: Column) -> Column:
            longer = (b["stop"] - b["start"]) > (a["stop"] - a["start"])
            equal = (b["stop"] - b["start"]) == (a["stop"] - a["start"])
            return (b["start"] <= a["start"]) & (b["stop"] >= a["stop"]) & (longer | (equal & (b["rule"] < a["rule"])))

        return F.exists(found, beats)

    return F.filter(found, lambda a: ~beaten(a))


def license_scan(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """Base counts and labels of each row, the surviving detections and their best score."""
    signatures = rules() if signatures is None else signatures
    base = [f"b{k}" for k in range(len(BASE))]
    scanned = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalized(F.col("text")).alias("norm"))
        .withColumn("padded", F.concat(F.lit(" "), F.col("norm"), F.lit(" ")))
        .withColumns({name: _base(F.col("padded"), phrase) for name, (phrase, _) in zip(base, BASE, strict=True)})
        .withColumn("present", _present(F.col("padded"), signatures))
        .withColumn("found", _detections(F.col("padded"), F.col("present"), signatures))
        .withColumn("detections", _surviving(F.col("found")))
    )
    labels = F.filter(
        F.array(*[F.when(F.col(f"{n}.n") > 0, F.lit(label)) for n, (_, label) in zip(base, BASE, strict=True)]),
        lambda x: x.isNotNull(),
    )
    score = F.array_max(F.transform("detections", lambda d: d["score"]))
    return scanned.withColumn("own", labels).select(
        "doc_id",
        F.when(F.col("norm") == "", 0).otherwise(_spaces(F.col("norm")) + 1).cast("long").alias("n_words"),
        sum((F.col(f"{n}.n") for n in base[1:]), F.col("b0.n")).alias("n_base"),
        F.least(*[F.col(f"{n}.first") for n in base]).alias("first_word"),
        F.greatest(*[F.col(f"{n}.last") for n in base]).alias("last_word"),
        F.array_join(F.array_sort("own"), ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_distinct(F.concat("own", F.transform("detections", lambda d: d["label"])))), ","
        ).alias("labels"),
        F.coalesce(score, F.when(F.size("own") > 0, 0.8).otherwise(0.0)).cast("double").alias("score"),
        "detections",
    )
