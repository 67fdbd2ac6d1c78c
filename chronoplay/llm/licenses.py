"""License scans: an Aho-Corasick automaton and a shunting-yard parser.

A text is reduced to its words (lower case, joined by single spaces) by one
byte translation. One automaton finds all notice phrases and identifier tags in
it in a single pass. Where a tag stands, the licence expression after it in the
original text is put into postfix form by the shunting-yard algorithm and
evaluated: ``and`` needs all its licences, ``or`` leaves the choice of the
least restrictive side, ``with`` relaxes the licence before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import byte_slices

#: Phrases whose places are counted, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices, which only add labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "isc license": "isc",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "creative commons attribution": "cc-by",
    "cc0 1 0 universal": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: What may follow Creative Commons' attribution, spelled in one word or two, and the letters that stand for it.
_NC, _ND, _SA = ("noncommercial", "non commercial"), ("noderivatives", "no derivatives", "noderivs", "no derivs"), ("sharealike", "share alike")
NOTICES |= {f"creative commons attribution {' '.join(words)}": "-".join(["cc-by", *letters]) for letters, kinds in ((("nc",), (_NC,)), (("nd",), (_ND,)), (("sa",), (_SA,)), (("nc", "nd"), (_NC, _ND)), (("nc", "sa"), (_NC, _SA))) for words in product(*kinds)}
NOTICES |= {f"cc by {x.replace('-', ' ')}": f"cc-by-{x}" for x in ("nc", "nd", "sa", "nc-nd", "nc-sa")}
TAG = "spdx license identifier"
#: Restriction of a licence family: 0 none, 1 attribution, 2 weak copyleft, 3 copyleft, 4 unknown, reserved, or no commerce or changes.
RESTRICTION = {
    "cc0": 0, "unlicense": 0, "public-domain": 0, "0bsd": 0,
    "mit": 1, "bsd": 1, "isc": 1, "apache": 1, "boost": 1, "zlib": 1, "cc-by": 1,
    "lgpl": 2, "mpl": 2, "epl": 2,
    "gpl": 3, "agpl": 3, "cc-by-sa": 3,
}
#: Whole identifiers of a family, in lower case, without what says "or later".
FAMILIES = (
    ("agpl", r"agpl(-\d(\.\d)?)?"), ("lgpl", r"lgpl(-\d(\.\d)?)?"), ("gpl", r"gpl(-\d(\.\d)?)?"), ("apache", r"apache(-\d(\.\d)?)?"), ("mit", r"mit(-(0|cmu|feh|enna|modern-variant))?|expat"),
    ("bsd", r"bsd(-[1-4]-clause(-(clear|patent|views|attribution|uc|shortened|lbnl))?)?"), ("0bsd", r"0bsd"), ("isc", r"isc"), ("mpl", r"mpl(-\d(\.\d)?(-no-copyleft-exception)?)?"), ("epl", r"epl(-\d(\.\d)?)?"),
    ("boost", r"bsl-1\.0|boost(-1\.0)?"), ("busl", r"busl(-\d\.\d)?|bsl-1\.1"), ("zlib", r"zlib(-acknowledgement)?"), ("cc0", r"cc0(-\d\.\d)?"), ("unlicense", r"unlicense"),
    *(("-".join(["cc-by", *x]), "-".join(["cc-by", *x]) + r"(-\d\.\d(-[a-z]{2,3})?)?") for x in ((), ("nc",), ("nd",), ("sa",), ("nc", "nd"), ("nc", "sa"))),
)
#: Exceptions, without version, that let other code be linked or used under other terms.
EXCEPTIONS = frozenset(
    "autoconf-exception bison-exception bootloader-exception classpath-exception fltk-exception font-exception gcc-exception gnu-javamail-exception libtool-exception "
    "linux-syscall-note llvm-exception ocaml-lgpl-linking-exception openjdk-assembly-exception qt-gpl-exception qt-lgpl-exception qwt-exception swift-exception u-boot-exception "
    "universal-foss-exception wxwindows-exception".split()
)
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: How strongly a tag, a base phrase and another notice speak for a licence.
WEIGHTS = {"tag": 0.9, "base": 0.7, "notice": 0.5}

_words = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_tag_at = re.compile(r"spdx-license-identifier:", re.I)
#: A token of an expression, on the same line.
_token = re.compile(r"[^\S\r\n]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_families = [(label, re.compile(pattern)) for label, pattern in FAMILIES]


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 text: digits, letters and everything beyond ASCII."""
    return text.translate(_words).split()


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in [*NOTICES.items(), *BASE.items(), (TAG, "")]:
        kind = "base" if phrase in BASE else "tag" if phrase == TAG else "notice"
        found.add_word(f" {phrase} ", (kind, label, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def expression_tokens(text: str, at: int) -> list[str]:
    """Tokens of the expression that starts at ``at``: up to the line's end, the next tag, or what can't continue it."""
    tokens: list[str] = []
    depth, operand = 0, True  # operand: one is due
    while (m := _token.match(text, at)) is not None:
        t = m[1]
        if _tag_at.fullmatch(t):
            break
        if t == "(":
            if not operand:
                break
            depth += 1
        elif t == ")":
            if operand or not depth:
                break
            depth -= 1
        elif t.lower() in PRECEDENCE:
            if operand:
                break
            operand = True
        elif operand:
            operand = False
        else:
            break
        tokens.append(t)
        at = m.end()
    while tokens and (tokens[-1] == "(" or tokens[-1].lower() in PRECEDENCE):
        depth -= tokens.pop() == "("
    return tokens + [")"] * max(0, depth)


def postfix(tokens: Sequence[str]) -> list[str]:
    """Dijkstra's shunting yard: operators wait on a stack for weaker ones."""
    out, stack = [], []
    for t in tokens:
        if t == "(":
            stack.append(t)
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if stack:
                stack.pop()
        elif (op := t.lower()) in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[op]:
                out.append(stack.pop())
            stack.append(op)
        else:
            out.append(t)
    return out + stack[::-1]


@lru_cache(maxsize=4096)
def family(identifier: str) -> str:
    """The family whose identifiers have this one among them; any other stands for itself."""
    low = identifier.lower().rstrip("+").removesuffix("-or-later").removesuffix("-only")
    return next((label for label, pattern in _families if pattern.fullmatch(low)), low)


def loosened(restriction: int, exception: str) -> int:
    """What a known exception leaves of copyleft; one that isn't known changes nothing."""
    return 2 if restriction == 3 and re.sub(r"-\d+(\.\d+)*$", "", exception.lower()) in EXCEPTIONS else restriction


def evaluate(tokens: Sequence[str]) -> tuple[frozenset[str], int] | None:
    """(labels, restriction 0 to 4) of an expression; None for an empty one."""
    names: list[tuple[str, str]] = []  # licences and families in order; a subexpression's are those from its start on
    stack: list[tuple[int, int]] = []  # (restriction, start)
    for t in postfix(tokens):
        if t in PRECEDENCE:
            if len(stack) < 2:
                return None
            (b, cut), (a, start) = stack.pop(), stack.pop()
            if t == "with":  # an exception isn't a licence
                exception = names[cut][0] if len(names) == cut + 1 else ""
                del names[cut:]
                stack.append((loosened(a, exception), start))
            else:
                stack.append((max(a, b) if t == "and" else min(a, b), start))
        else:
            stack.append((RESTRICTION.get(f := family(t), 4), len(names)))
            names.append((t, f))
    return (frozenset(f for _, f in names[stack[-1][1] :]), stack[-1][0]) if stack else None


_known = lru_cache(maxsize=4096)(evaluate)


def value_of(text: str, at: int) -> tuple[frozenset[str], int] | None:
    """What the expression at ``at`` evaluates to; short ones are remembered, as files of a repository share them."""
    tokens = expression_tokens(text, at)
    return _known(tuple(tokens)) if len(tokens) <= 16 else evaluate(tokens)


def scan(raw: bytes) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, n_tags, restriction) of one text."""
    words = words_of(raw)
    line = f" {b' '.join(words).decode()} "
    base, labels, hits, n_base, first, last, doubt = set(), set(), [], 0, None, None, 1.0
    at = spaces = 0
    for end, (kind, label, length) in automaton().iter(line):
        spaces += line.count(" ", at, end)  # ends come in order
        at = end
        hits.append((kind, label, spaces - length, length))
    longest: dict[int, tuple[int, str]] = {}  # of notices that start together, only the longest counts
    for kind, label, start, length in hits:
        if kind == "base":
            n_base += 1
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
            base.add(label)
        elif kind == "notice":
            longest[start] = max(longest.get(start, (0, "")), (length, label))
    labels |= {label for _, label in longest.values()}
    restriction, n_tags = None, 0
    if any(kind == "tag" for kind, *_ in hits):
        text = raw.decode()
        for m in _tag_at.finditer(text):
            if (value := value_of(text, m.end())) is not None:
                n_tags += 1
                labels |= value[0]
                restriction = value[1] if restriction is None else max(restriction, value[1])
    for kind, there in (("tag", n_tags), ("base", n_base), ("notice", bool(longest))):
        if there:
            doubt *= 1 - WEIGHTS[kind]
    if restriction is None and (labels or base):
        restriction = max(RESTRICTION.get(x, 4) for x in labels | base)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), round(1 - doubt, 6), n_tags, restriction


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_tags long, restriction int"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id and what ``scan`` finds in its whole text.

    ``n_base`` counts all places of the base phrases, ``first_word`` and
    ``last_word`` are their smallest and largest start (null without any),
    ``labels`` holds the base labels and the method's. ``restriction`` is that
    of the tags, else of the strictest label (null: no licence found). A text of
    any length and any number of tags is scanned in linear time. Null
    counts as empty: 0 words, no labels (empty strings), score 0. Repeated rows
    and null ids are scanned like others; an empty table gives an empty result.
    Only the two named columns are read.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.int32()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(data[s:e].tobytes()) for _, _, data, at in byte_slices(b.column(1)) for s, e in zip(at[:-1], at[1:], strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["_id", *names])

    kind = base.schema["_id"].dataType.simpleString()
    return base.mapInArrow(run, f"_id {kind}, {SCHEMA}").select(F.col("_id").alias(id_col), *names)
