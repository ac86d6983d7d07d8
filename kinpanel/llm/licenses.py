"""License scan: ordered signature rules behind a keyword test, overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Every byte that is no ASCII letter, digit or part of a non-ASCII character parts words; A-Z become small.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Phrases that always count, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Families of licenses: keyword that must occur, names as word patterns, versions, label.
_FAMILIES = [
    ("apache", r"apache(?: software)?(?: foundation)?", ["1 0", "1 1", "2 0"], "apache"),
    ("general public", r"(?:gnu )?general public licen[sc]e", ["1", "1 0", "2", "2 0", "2 1", "3", "3 0"], "gpl"),
    ("gpl", r"gpl", ["1", "1 0", "2", "2 0", "3", "3 0"], "gpl"),
    ("lesser", r"(?:gnu )?lesser general public licen[sc]e", ["2", "2 1", "3", "3 0"], "lgpl"),
    ("library", r"(?:gnu )?library general public licen[sc]e", ["2", "2 0"], "lgpl"),
    ("lgpl", r"lgpl", ["2", "2 0", "2 1", "3", "3 0"], "lgpl"),
    ("affero", r"(?:gnu )?affero general public licen[sc]e", ["1", "3", "3 0"], "agpl"),
    ("agpl", r"agpl", ["1", "3", "3 0"], "agpl"),
    ("free documentation", r"(?:gnu )?free documentation licen[sc]e", ["1 1", "1 2", "1 3"], "gfdl"),
    ("mozilla", r"mozilla public licen[sc]e", ["1 0", "1 1", "2 0"], "mpl"),
    ("mpl", r"mpl", ["1 0", "1 1", "2 0"], "mpl"),
    ("eclipse", r"eclipse (?:public|distribution) licen[sc]e", ["1 0", "2 0"], "epl"),
    ("common development", r"common development and distribution licen[sc]e", ["1 0", "1 1"], "cddl"),
    ("cddl", r"cddl", ["1 0", "1 1"], "cddl"),
    ("common public", r"common public licen[sc]e", ["0 5", "1 0"], "cpl"),
    ("academic free", r"academic free licen[sc]e", ["1 1", "1 2", "2 0", "2 1", "3 0"], "afl"),
    ("open software", r"open software licen[sc]e", ["1 0", "1 1", "2 0", "2 1", "3 0"], "osl"),
    ("european union", r"european union public licen[sc]e", ["1 0", "1 1", "1 2"], "eupl"),
    ("artistic", r"artistic licen[sc]e", ["1 0", "2 0"], "artistic"),
    ("boost", r"boost software licen[sc]e", ["1 0"], "bsl"),
    ("business source", r"business source licen[sc]e", ["1 0", "1 1"], "busl"),
    ("server side", r"server side public licen[sc]e", ["1", "1 0"], "sspl"),
    ("elastic", r"elastic licen[sc]e", ["1 0", "2 0"], "elastic"),
    ("open data", r"open data commons(?: open database| attribution)? licen[sc]e", ["1 0"], "odc"),
    ("microsoft", r"microsoft (?:public|reciprocal) licen[sc]e", ["1 0"], "ms"),
    ("zope", r"zope public licen[sc]e", ["1 1", "2 0", "2 1"], "zpl"),
    ("python", r"python (?:software foundation )?licen[sc]e", ["2", "2 0"], "psf"),
    ("php", r"php licen[sc]e", ["3 0", "3 01"], "php"),
    ("latex", r"latex project public licen[sc]e", ["1 0", "1 1", "1 2", "1 3"], "lppl"),
    ("open font", r"(?:sil )?open font licen[sc]e", ["1 0", "1 1"], "ofl"),
]
# Creative Commons: every combination of terms has a rule for each version.
_TERMS = ["by", "by nc", "by sa", "by nd", "by nc sa", "by nc nd"]
_CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
_LONG = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?"}
# Rules without versions: keyword, pattern, label, priority.
_PLAIN = [
    ("mit", r"(?:the )?mit licen[sc]e", "mit", 60),
    ("permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy", "mit", 70),
    ("bsd", r"(?:new |simplified |modified )?bsd licen[sc]e", "bsd", 50),
    ("bsd", r"bsd (?:0|1|2|3|4) clause(?: licen[sc]e)?", "bsd", 60),
    ("redistribution and use", r"redistribution and use in source and binary forms", "bsd", 70),
    ("isc", r"isc licen[sc]e", "isc", 60),
    ("permission to use", r"permission to use copy modify and or distribute this software", "isc", 70),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", "zlib", 60),
    ("unlicense", r"(?:the )?unlicense", "unlicense", 60),
    ("public domain", r"(?:released|placed|dedicated)(?: \S+){0,3} public domain", "public-domain", 60),
    ("public domain", r"public domain", "public-domain", 30),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0", 60),
    ("do what the", r"do what the \S+ you want to public licen[sc]e", "wtfpl", 60),
    ("beerware", r"beerware licen[sc]e", "beerware", 60),
    ("spdx", r"spdx licen[sc]e identifier \S+", "spdx", 80),
    ("copyright", r"copyright(?: c)? (?:19|20)\d\d", "copyright", 40),
    ("copyright", r"copyright(?: c)? \S+", "copyright", 20),
    ("proprietary", r"proprietary and confidential", "proprietary", 60),
    ("without prior written", r"without(?: the)? prior written (?:permission|consent)", "proprietary", 50),
    ("licensed", r"licensed under(?: the)? \S+(?: \S+)? licen[sc]e", "other-license", 10),
]


def rules() -> list[tuple[str, str, str, int]]:
    """(keyword, pattern over space-parted small words, label, priority), highest priority first."""
    out = list(_PLAIN)
    for word, name, versions, label in _FAMILIES:
        plain = name if name.endswith("e") or label.endswith(name) else name + r" licen[sc]e"
        out.append((word, plain, label, 50))
        for v in versions:
            out.append((word, f"{name}(?: licen[sc]e)?(?: version)? v?{v}", f"{label}-{v.replace(' ', '.')}", 60))
            out.append((word, f"{name}(?: licen[sc]e)?(?: version)? v?{v} or(?: at your option)?(?: any)? later", f"{label}-{v.replace(' ', '.')}+", 65))
    for terms in _TERMS:
        spelled = " ".join(_LONG[t] for t in terms.split())
        label = "cc-" + terms.replace(" ", "-")
        out.append(("cc by", f"cc {terms}", label, 40 + len(terms)))
        out.append(("creative commons", f"creative commons {spelled}", label, 40 + len(terms)))
        for v in _CC_VERSIONS:
            out.append(("cc by", f"cc {terms} {v}", f"{label}-{v.replace(' ', '.')}", 60 + len(terms)))
            out.append(("creative commons", f"creative commons {spelled}(?: (?!{_LONG['nc']}|{_LONG['sa']}|{_LONG['nd']})\\S+){{0,3}} {v}", f"{label}-{v.replace(' ', '.')}", 60 + len(terms)))
    return sorted(out, key=lambda r: (-r[3], r[0], r[1]))


def compiled() -> list[tuple[bytes, re.Pattern, str, int]]:
    """Rules over bytes; a match starts and ends at word borders."""
    return [(k.encode(), re.compile(rb"(?<= )(?:" + p.encode() + rb")(?= )"), label, n) for k, p, label, n in rules()]


def resolve(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Detections (start, end, label, priority) that stand: a detection inside the span of an accepted one of higher
    priority, or of the same priority and at least its length, falls. Ties: longer, then earlier, then by label."""
    kept: list[tuple[int, int, str, int]] = []
    for f in sorted(set(found), key=lambda f: (-f[3], f[0] - f[1], f[0], f[2])):
        if not any(k[0] <= f[0] and f[1] <= k[1] for k in kept):
            kept.append(f)
    return sorted(kept)


def scan(text: bytes, ordered, gate: re.Pattern) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of one text."""
    words = text.translate(_FOLD).split()
    flat = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in BASE.items():
        sought, at = b" " + phrase.encode() + b" ", flat.find(b" " + phrase.encode() + b" ")
        while at >= 0:
            starts.append(at)
            base.add(label)
            at = flat.find(sought, at + 1)
    word_at = lambda at: flat.count(b" ", 0, at)
    spans: list[tuple[int, int, str, int]] = []
    if gate.search(flat):
        spans = resolve([(m.start(), m.end(), label, n) for key, pattern, label, n in ordered if key in flat for m in pattern.finditer(flat)])
    labels = sorted(base | {s[2] for s in spans})
    # The strongest rule gives the score; base phrases alone count half.
    score = max([s[3] / 100 for s in spans] + [0.5] * bool(base) + [0.0])
    first, last = (word_at(min(starts)), word_at(max(starts))) if starts else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(labels), score, [(word_at(s[0] - 1), len(flat[s[0] : s[1]].split()), s[2]) for s in spans]


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<word:long,words:long,label:string>>"
)


def scan_licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License statements of every document: one row per input row, in one pass without a shuffle.

    Words are runs of ASCII letters, digits and non-ASCII characters, in small letters. A text is tested for the
    keywords of all rules first; each rule whose keyword stands in the text is then matched over the whole text.
    A null or empty text has no words, no labels, null first and last word and score 0. Repeated rows and null
    ids give a row each; other columns are not read. Labels are distinct and sorted.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    schema = SCHEMA.replace("doc_id long", f"doc_id {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = compiled()
        gate = re.compile(b"|".join(sorted({re.escape(k) for k, *_ in ordered})))
        for batch in batches:
            rows = [scan(t.as_py() or b"", ordered, gate) for t in batch.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            spans = [[{"word": a, "words": b, "label": c} for a, b, c in s] for s in cols[7]]
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            arrays = [batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols[:7], types, strict=True))]
            arrays.append(pa.array(spans, pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))))
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return documents.select(F.col(id_col), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, schema)


def op9_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
