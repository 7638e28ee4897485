"""License scans: full texts and notices of common licenses.

Candidates of a full text (``license_texts/``) are blocks that hold enough of its runs of ``RUN`` words. A block is compressed with each full
text as a raw zstandard dictionary; the texts that save about the most bytes are confirmed by matching words, the others only if none of
those is there, and the one with the fewest changed words is taken. Candidates of a notice are the places of its naming words, which must be there exactly and without a word between
them. Both allow ``DIFFERENT`` of the words to be changed. A notice's block is compressed with each notice as a raw zstandard
dictionary; notices are tried by the bytes saved.
"""

from __future__ import annotations

import pkgutil
import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from reelmill.llm.common import pick

# Fixed notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}
# Further notices and headers; naming words in braces.
_GPL = "under the terms of the {%s} as published by the Free Software Foundation, {either version %s of the License}"
NOTICES = [
    ("Apache-2.0", "Licensed under the {Apache License, Version 2.0}"), ("Apache-2.0", "Licensed under the {Apache License 2.0}"),
    ("Apache-1.1", "Licensed under the {Apache License, Version 1.1}"),
    ("GPL", "This work is licensed under the {GNU General Public License, version 3}"),
    ("GPL-2", "This work is licensed under the {GNU General Public License, version 2}"),
    *[(n, "This work is licensed under the {GNU %s General Public License, version %s}" % (k, v))
      for n, k, v in (("LGPL-3", "Lesser", "3"), ("LGPL-2.1", "Lesser", "2.1"), ("AGPL-3", "Affero", "3"))],
    *[(n, _GPL % (k, v)) for n, k, v in (
        ("GPL", "GNU General Public License", "3"), ("GPL-2", "GNU General Public License", "2"), ("LGPL-3", "GNU Lesser General Public License", "3"),
        ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("AGPL-3", "GNU Affero General Public License", "3"))],
    ("MPL-2.0", "subject to the terms of the {Mozilla Public License, v. 2.0}"), ("MPL-1.1", "subject to the {Mozilla Public License Version 1.1}"),
    *[(n, f"Released under the {{{k} License}}") for n, k in (("MIT", "MIT"), ("BSD", "BSD"), ("ISC", "ISC"))],
    *[(f"CC-{k}-{v}", f"Licensed under {{CC {k} {v}}}") for k in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")],
    *[(n, "{SPDX-License-Identifier: %s}" % i) for n, i in (
        ("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL", "GPL-3.0-only"), ("GPL", "GPL-3.0-or-later"), ("GPL-2", "GPL-2.0-only"),
        ("GPL-2", "GPL-2.0-or-later"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0"), ("ISC", "ISC"))],
]
FULL = ("Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1", "GPL-2", "GPL-3",
        "ISC", "LGPL-2", "LGPL-2.1", "LGPL-3", "MIT", "MPL-1.1", "MPL-2.0")
RUN = 4
ENOUGH = 0.2  # share of a full text's runs in a candidate; even evenly spread changes of a fifth of the words leave about this many
DIFFERENT = 0.2
CLOSE = 0.9  # share of the most bytes saved from which a text's words decide
_WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")


def _words(text: str) -> list[str]:
    return " ".join(_WORD.findall(text)).lower().split()


@lru_cache(maxsize=1)
def _notices() -> tuple[list[tuple[str, list[str], list[bool]]], dict[str, list[tuple[int, int]]]]:
    """(license, words, whether they name it) and the notices and places by their first naming word."""
    out, anchors = [], defaultdict(list)
    for name, marked in NOTICES:
        parts = [(w, i % 2 == 1) for i, part in enumerate(re.split("[{}]", marked)) for w in _words(part)]
        first = next(i for i, (_, named) in enumerate(parts) if named)
        anchors[parts[first][0]].append((len(out), first))
        out.append((name, [w for w, _ in parts], [named for _, named in parts]))
    return out, dict(anchors)


@lru_cache(maxsize=1)
def _full() -> tuple[dict[str, list[str]], dict[tuple, list[tuple[str, int]]], dict[str, int]]:
    """Words of the full texts, the texts and places of the runs that a text has once, and the number of such runs."""
    texts = {n: _words(pkgutil.get_data(__package__, f"license_texts/{n}.txt").decode()) for n in FULL}
    runs, single = defaultdict(list), {}
    for n, w in texts.items():
        places = defaultdict(list)
        for at, run in enumerate(zip(*(w[i:] for i in range(RUN)))):
            places[run].append(at)
        once = {run: at[0] for run, at in places.items() if len(at) == 1}
        single[n] = len(once)
        for run, at in once.items():
            runs[run].append((n, at))
    return texts, dict(runs), single


@lru_cache(maxsize=1)
def _compressors() -> list[zstandard.ZstdCompressor]:
    raw = [zstandard.ZstdCompressionDict(re.sub("[{}]", "", t).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t in NOTICES]
    return [zstandard.ZstdCompressor(level=9, dict_data=d) for d in raw]


@lru_cache(maxsize=1)
def _full_compressors() -> tuple[zstandard.ZstdCompressor, dict[str, zstandard.ZstdCompressor]]:
    """Without a dictionary, and with each full text as one."""
    out = {}
    for n, w in _full()[0].items():
        raw = zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=9)
        out[n] = zstandard.ZstdCompressor(level=9, dict_data=raw)
    return zstandard.ZstdCompressor(level=9), out


def differing(words: list[str], wanted: list[str], named: list[bool] | None = None) -> float:
    """Words to replace, insert or delete to turn one list into the other; naming words stay, and nothing comes between two of them."""
    named, never = named or [False] * len(wanted), float("inf")
    row: list[float] = [0]
    for x, keep in zip(wanted, named):
        row.append(never if keep else row[-1] + 1)
    for w in words:
        new = [row[0] + 1]
        for j, x in enumerate(wanted):
            between = named[j] and j + 1 < len(wanted) and named[j + 1]
            new.append(min(never if between else row[j + 1] + 1, never if named[j] else new[j] + 1,
                           row[j] + (0 if w == x else never if named[j] else 1)))
        row = new
    return row[-1]


def _saved(words: list[str]) -> dict[str, int]:
    """Bytes that every full text as a raw dictionary saves in a block, against no dictionary."""
    data = " ".join(words).encode()
    plain, known = _full_compressors()
    alone = len(plain.compress(data))
    return {n: alone - len(c.compress(data)) for n, c in known.items()}


def _confirmed(words: list[str], block: tuple[str, int, int]) -> tuple[float, int, str, int, int, int] | None:
    """The place of a full text in a block, unless too many words differ."""
    name, start, stop = block
    wanted = _full()[0][name]
    same = [m for m in SequenceMatcher(None, words[start:stop], wanted, autojunk=False).get_matching_blocks() if m.size > 1]
    if not same:
        return None
    first, last = start + same[0].a, start + same[-1].a + same[-1].size
    changed = max(len(wanted), last - first) - sum(m.size for m in same)
    return (changed / len(wanted), -len(wanted), name, first, last, changed) if changed <= DIFFERENT * len(wanted) else None


def _full_in(words: list[str]) -> list[tuple[str, int, int, int]]:
    """(license, first word, word after the last, words that differ) of full texts."""
    texts, runs, single = _full()
    regions: dict[tuple[str, int], list[tuple[int, int]]] = defaultdict(list)  # overlapping, by where the text would start
    for i, run in enumerate(zip(*(words[k:] for k in range(RUN)))):
        for name, j in runs.get(run, ()):
            half = 2 * (i - j) // len(texts[name])
            regions[name, half].append((i, j))
            regions[name, half - 1].append((i, j))
    blocks = []  # (license, first word, word after the last) that may hold the text
    for (name, _), part in regions.items():
        if len({j for _, j in part}) >= ENOUGH * single[name]:
            middle, size = sorted(i - j for i, j in part)[len(part) // 2], len(texts[name])
            block = (name, max(0, middle - size // 4), min(len(words), middle + size + size // 4))
            if block not in blocks:
                blocks.append(block)
    tried, found = {}, []
    for _, start, stop in blocks:
        here = [b for b in blocks if b[1] < stop and start < b[2]]
        saved = _saved(words[start:stop])
        ranked = sorted({b[0] for b in here}, key=lambda n: (-saved[n], n))
        while ranked:  # texts that save about as much as the best are told apart by their words; others follow if none of these is there
            least = CLOSE * saved[ranked[0]]
            close = [n for n in ranked if saved[n] >= least] or ranked[:1]
            ranked = [n for n in ranked if n not in close]
            for b in here:
                if b[0] in close and b not in tried:
                    tried[b] = _confirmed(words, b)
            told = [tried[b] for b in here if b[0] in close and tried[b]]
            found += told
            if told:
                break
    out: list[tuple[str, int, int, int]] = []
    for _, _, name, first, last, changed in sorted(set(found)):
        if all(last <= o[1] or first >= o[2] for o in out):
            out.append((name, first, last, changed))
    return out


def _notices_in(words: list[str]) -> list[tuple[str, int, int, int]]:
    told, anchors = _notices()
    found = []
    for i, word in enumerate(words):
        tries = anchors.get(word, ())
        if len(tries) > 1:
            data = " ".join(words[max(0, i - 12) : i + 25]).encode()
            tries = sorted(tries, key=lambda t: len(_compressors()[t[0]].compress(data)))
        for t, place in tries:
            name, wanted, named = told[t]
            slack = int(DIFFERENT * len(wanted))
            spans = [(differing(words[s:e], wanted, named), abs(e - s - len(wanted)), s, e)
                     for s in range(max(0, i - place - slack), i + 1)
                     for e in range(s + len(wanted) - slack, min(len(words), s + len(wanted) + slack) + 1) if e > i]
            changed, _, s, e = min(spans, default=(len(words) + len(wanted), 0, 0, 0))
            if changed <= DIFFERENT * len(wanted):
                found.append((name, s, e, int(changed)))
                break
    return found


def found_in(text: str | None) -> list[tuple[str, int, int, int]]:
    """(license, start, stop, words that differ), by start; a notice within a full text counts as part of it."""
    words = _words(text or "")
    out: list[tuple[str, int, int, int]] = []
    for hit in _full_in(words) + _notices_in(words):
        if all(hit[2] <= o[1] or hit[1] >= o[2] for o in out):
            out.append(hit)
    if not out:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    return [(n, spans[s][0], spans[e - 1][1], d) for n, s, e, d in sorted(out, key=lambda o: o[1])]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [found_in(t) for t in batch["text"]]
        yield pd.DataFrame({
            "doc_id": batch["doc_id"], "n_licenses": [len(f) for f in found],
            "licenses": [",".join(f"{n}:{s}:{e}:{d}" for n, s, e, d in f) for f in found],
        })


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_licenses, licenses`` (name:start:stop:differing words, code points) per row.

    Null and empty texts have none, repeated rows their own, overlapping finds count once, empty input gives no rows.
    """
    docs = pick(df, id_col, text_col)
    return docs.mapInPandas(_scan, f"doc_id {dict(docs.dtypes)['doc_id']}, n_licenses int, licenses string")
