"""License scans: ordered signature rules over a text's normalised words.

Some rules are the texts, notices, addresses, identifiers and short names of ``license_rules``; others come from families of names,
of which the forms (tag, notice, version, bare name) make a rule each. A rule is tried only where its keyword is among the text's
words. Matches are taken by priority, and one that lies within a match already taken is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, table
from .license_rules import hand_written

#: label, keywords, pattern of the name, pattern of versions or ''. Every match of the name has one of the keywords. Patterns are over lower-case words with one blank between.
FAMILIES = [
    ("mit", "mit", "(?:the )?mit licen[sc]e", ""),
    ("mit-0", "mit", "mit (?:no attribution|0)", ""),
    ("x11", "x11", "x11 licen[sc]e", ""),
    ("isc", "isc", "isc licen[sc]e", ""),
    ("apache", "apache", "(?:the )?apache (?:software )?licen[sc]e", "1 0|1 1|2 0|2"),
    ("gpl", "general", "(?:gnu )?general public licen[sc]e", "1 0|1|2 0|2|3 0|3"),
    ("gpl", "gpl", "(?:gnu )?gpl(?: ?v)?", "1|2|3"),
    ("lgpl", "lesser library", "(?:gnu )?(?:lesser|library) general public licen[sc]e", "2 0|2 1|2|3 0|3"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?: ?v)?", "2 1|2|3"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e", "1 0|3 0|3"),
    ("agpl", "agpl", "(?:gnu )?agpl(?: ?v)?", "3"),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[sc]e", "1 1|1 2|1 3"),
    ("bsd", "bsd", "(?:the )?(?:new |revised |modified |simplified )?bsd licen[sc]e", ""),
    ("bsd-2-clause", "bsd", "bsd 2 clause(?: licen[sc]e)?", ""),
    ("bsd-3-clause", "bsd", "bsd 3 clause(?: licen[sc]e)?", ""),
    ("bsd-4-clause", "bsd", "bsd 4 clause(?: licen[sc]e)?", ""),
    ("0bsd", "0bsd", "0bsd", ""),
    ("mpl", "mozilla", "mozilla public licen[sc]e", "1 0|1 1|2 0|2"),
    ("mpl", "mpl", "mpl", "1 0|1 1|2 0|2"),
    ("epl", "eclipse", "eclipse public licen[sc]e", "1 0|2 0"),
    ("cddl", "distribution", "common development and distribution licen[sc]e", "1 0|1 1"),
    ("cpl", "common", "common public licen[sc]e", "1 0"),
    ("eupl", "eupl union", "(?:european union public licen[sc]e|eupl)", "1 0|1 1|1 2"),
    ("cc-by", "cc", "cc by", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-sa", "cc", "cc by sa", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc", "cc", "cc by nc", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nd", "cc", "cc by nd", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc-sa", "cc", "cc by nc sa", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc-nd", "cc", "cc by nc nd", "1 0|2 0|2 5|3 0|4 0"),
    ("cc0", "cc0", "cc0", "1 0"),
    ("cc-by", "creative", "creative commons attribution(?: (?:international|unported))?(?: licen[sc]e)?", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: licen[sc]e)?", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: licen[sc]e)?", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:ative)?s(?: licen[sc]e)?", "1 0|2 0|2 5|3 0|4 0"),
    ("public-domain", "domain", "(?:dedicated to|released into|placed in) the public domain", ""),
    ("unlicense", "unlicense", "(?:the )?unlicense", ""),
    ("wtfpl", "wtfpl", "wtfpl", ""),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", ""),
    ("bsl", "boost", "boost software licen[sc]e", "1 0"),
    ("busl", "business", "business source licen[sc]e", "1 1"),
    ("artistic", "artistic", "artistic licen[sc]e", "1 0|2 0"),
    ("psf", "python", "python software foundation licen[sc]e", "2"),
    ("php", "php", "php licen[sc]e", "3 0|3 01"),
    ("openssl", "openssl", "openssl licen[sc]e", ""),
    ("ofl", "sil", "sil open font licen[sc]e", "1 0|1 1"),
    ("odbl", "odbl database", "(?:open database licen[sc]e|odbl)", "1 0"),
    ("odc-by", "odc", "odc (?:by|attribution licen[sc]e)", "1 0"),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", ""),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e", ""),
    ("sspl", "sspl side", "(?:server side public licen[sc]e|sspl)", "1"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e", ""),
    ("ecl", "educational", "educational community licen[sc]e", "1 0|2 0"),
    ("afl", "academic", "academic free licen[sc]e", "2 1|3 0"),
    ("osl", "open", "open software licen[sc]e", "2 1|3 0"),
    ("vim", "vim", "vim licen[sc]e", ""),
    ("openrail", "openrail", "(?:creativeml )?openrail(?: m| s)?(?: licen[sc]e)?", ""),
    ("llama", "llama", "llama (?:2|3|3 1|3 2|4) community licen[sc]e", ""),
]
#: Form, priority, confidence, pattern around the name (N) and version (V).
FORMS = [
    ("tag", 5, 0.99, "spdx license identifier N(?: V)?(?: only| or later)?"),
    ("notice", 4, 0.95, "(?:licen[sc]ed|released|distributed|available|published) (?:to you )?under (?:the )?(?:terms of )?(?:the )?N(?:(?: version| v)? ?V)?"),
    ("subject", 3, 0.9, "(?:subject to|governed by|redistribute it and or modify it under) (?:the )?(?:terms of )?(?:the )?N(?:(?: version| v)? ?V)?"),
    ("version", 2, 0.85, "N(?: version| v)? ?V"),
    ("name", 1, 0.7, "N"),
]
#: What the base counts: words that stand together, and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Families whose bare name is too common a word sequence to say anything; they need a tag, notice or version.
NAME_ONLY_UNSAFE = {"cpl", "osl", "mpl", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "gpl"}


def _joined(keywords: str, versions: str) -> set[str]:
    """The keywords as words: a version, or a v, can be written to a name without a blank (gplv3, mpl2)."""
    numbers = {"", *(v.split()[0] for v in versions.split("|") if v)}
    return {k + v + n for k in keywords.split() for v in ("", "v") for n in numbers}


@cache
def rules() -> tuple[dict[bytes, list[int]], list[tuple[str, int, float, re.Pattern]]]:
    """By keyword the numbers of its rules; and the rules: label, priority, confidence, pattern."""
    made, by = [], {}
    for label, keywords, name, versions in FAMILIES:
        for form, priority, confidence, around in FORMS:
            if "V" in around.replace("N", "") and form == "version" and not versions:
                continue
            if form == "name" and label in NAME_ONLY_UNSAFE and "licen" not in name:
                continue
            body = around.replace("V", f"(?:{versions})" if versions else "(?!)").replace("N", f"(?:{name})")
            for k in _joined(keywords, versions):
                by.setdefault(k.encode(), []).append(len(made))
            made.append((label, priority, confidence, re.compile(rf"(?<![^ ]){body}(?![^ ])")))
    for label, keywords, priority, confidence, body in hand_written():
        for k in keywords.split():
            by.setdefault(k.encode(), []).append(len(made))
        made.append((label, priority, confidence, re.compile(rf"(?<![^ ]){body}(?![^ ])")))
    return by, made


def scan(words: list[bytes], *, gate: bool = True) -> list[tuple[int, int, str, int, float]]:
    """Surviving matches (first word, end, label, priority, confidence), by first word. Without ``gate`` all rules are tried, with the same result."""
    by, made = rules()
    present = by.keys() & set(words) if gate else by.keys()
    if not present:
        return []
    line = b" ".join(words).decode("utf-8", "surrogatepass")
    found = []
    for r in sorted({i for k in present for i in by[k]}):
        label, priority, confidence, pattern = made[r]
        part = min(pattern.groups, 1)
        found += [(-priority, m.start(part) - m.end(part), m.start(part), m.end(part), label, confidence) for m in pattern.finditer(line)]
    if not found:
        return []
    blanks = [m.start() for m in re.finditer(" ", line)]
    starts, ends, out = [], [], []  # of the taken matches that lie in no other: both ascend
    for p, _, a, b, label, confidence in sorted(found):
        k = bisect_right(starts, a)
        if k and ends[k - 1] >= b:
            continue
        last = k
        while last < len(ends) and ends[last] <= b:
            last += 1
        if k and starts[k - 1] == a:
            k -= 1
        starts[k:last], ends[k:last] = [a], [b]
        out.append((bisect_left(blanks, a), bisect_left(blanks, b) + 1, label, -p, confidence))
    return sorted(out)


_BASE = [(re.compile(rb"(?<![^ ])" + p.encode() + rb"(?![^ ])"), label) for p, label in PHRASES]


def base(words: list[bytes]) -> list[tuple[int, str]]:
    """Places and labels of the base phrases."""
    if b"license" not in words:
        return []
    line = b" ".join(words)
    found = [(m.start(), label) for pattern, label in _BASE for m in pattern.finditer(line)]
    blanks = [m.start() for m in re.finditer(b" ", line)] if found else []
    return [(bisect_left(blanks, at), label) for at, label in found]


def scan_licenses(documents: DataFrame, *, text: str = "text") -> DataFrame:
    """``documents`` with n_words, base_places, matches (start, end, label, priority, confidence; in words), labels, score.

    score is the chance that any of the matches is right, taking confidences as independent; 0 without one. A null text
    has no words; columns named like a new one are replaced; rows stay as they are otherwise.
    """
    new = {
        "n_words": (pa.int64(), "bigint"),
        "base_places": (pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])), "array<struct<word:bigint,label:string>>"),
        "matches": (pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int64()), ("confidence", pa.float64())])), "array<struct<start:bigint,end:bigint,label:string,priority:bigint,confidence:double>>"),
        "labels": (pa.list_(pa.string()), "array<string>"),
        "score": (pa.float64(), "double"),
    }
    source = documents.withColumn("__text", F.col(text))
    kept = [f for f in documents.schema.fields if f.name not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in new}
            for t in b.column("__text").to_pylist():
                words = alnum_words(t)
                places, matches = base(words), scan(words)
                doubt = 1.0
                for m in matches:
                    doubt *= 1 - m[4]
                out["n_words"].append(len(words))
                out["base_places"].append([{"word": w, "label": k} for w, k in places])
                out["matches"].append([dict(zip(("start", "end", "label", "priority", "confidence"), m, strict=True)) for m in matches])
                out["labels"].append(sorted({m[2] for m in matches} | {k for _, k in places}))
                out["score"].append(1 - doubt if matches else 0.7 * bool(places))
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + [pa.array(out[k], kind[0]) for k, kind in new.items()], [f.name for f in kept] + list(new))

    return source.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{k} {kind[1]}" for k, kind in new.items()]))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("bigint").alias("n_base"),
        F.array_min("base_places.word").alias("first_word"),
        F.array_max("base_places.word").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct("base_places.label"))).alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"),
        "score",
    )
