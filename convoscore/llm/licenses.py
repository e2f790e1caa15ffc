"""License scan by conditional compression.

Candidate blocks - runs of sentences with words of licensing - are compressed alone and with each template as a raw
zstandard dictionary.  The templates that save the most are the block's candidates, and only they are compared with it
word by word; a candidate whose wording the block really has is confirmed.  The words that are explained that way are
taken out, and what is left of the block is ranked again, until nothing is confirmed: so a block may hold several notices,
each of which has to win a ranking.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, worker_cache

#: Licence names with the wordings of public notices and file headers.  The texts themselves are whole, in
#: license_texts/ (without list numbers and appendices), for those licences that have a file there.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "all-rights-reserved": ["All rights reserved."],
}

#: Names that notices give licences.
CALLED: dict[str, list[str]] = {
    "MIT": ["MIT", "Expat"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0", "Apache v2", "Apache Software License 2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GNU GPL v3", "GPL version 3", "GPL v3", "GPLv3", "GPL 3.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GNU GPL v2", "GPL version 2", "GPL v2", "GPLv2", "GPL 2.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL version 3", "LGPL version 3", "LGPL v3", "LGPLv3", "LGPL 3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL version 2.1", "LGPL version 2.1", "LGPL v2.1", "LGPLv2.1", "LGPL 2.1"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL version 3", "AGPL version 3", "AGPL v3", "AGPLv3", "AGPL 3.0"],
    "BSD-2-Clause": ["BSD 2-Clause", "2-Clause BSD", "Simplified BSD", "FreeBSD"],
    "BSD-3-Clause": ["BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD", "Revised BSD"],
    "ISC": ["ISC"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPLv2"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL 1.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "OFL 1.1"],
    "ODbL-1.0": ["Open Database License", "Open Data Commons Open Database License", "ODbL 1.0", "ODbL"],
    "Zlib": ["zlib"],
    "CC0-1.0": ["CC0 1.0", "CC0"],
    "Unlicense": ["Unlicense"],
}
#: The parts of Creative Commons licences, and the versions that are looked for.
CREATIVE = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
CREATIVE_KINDS, CREATIVE_VERSIONS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"), ("3.0", "4.0")


def _names() -> dict[str, list[str]]:
    """Every licence with its names."""
    out = dict(CALLED)
    for kind in CREATIVE_KINDS:
        for version in CREATIVE_VERSIONS:
            long = "-".join(CREATIVE[x] for x in kind.split("-"))
            out[f"CC-{kind}-{version}"] = [f"CC {kind} {version}", f"Creative Commons {long} {version}", f"Creative Commons {long} {version} International", f"Creative Commons {long} {version} Unported"]
    return out


def wordings() -> dict[str, list[str]]:
    """Every licence with the wordings that tell of it: those of TEMPLATES, and what notices say with its names."""
    out = {name: list(forms) for name, forms in TEMPLATES.items()}
    for name, called in _names().items():
        forms = out.setdefault(name, [])
        for x in called:
            named = [x] if "License" in x else [x, f"{x} License"]
            forms += [f"{lead} {n}" for n in named for lead in ("under", "under the", "under a", "under the terms of the", "License:", "licensed as", "subject to the")]
            # a second licence; a bare word like MIT may be anything there
            sure = [n for n in named if "License" in n or any(c.isdigit() for c in n)]
            forms += [f"{lead} {n}" for n in sure for lead in ("or", "or the", "and", "and the")]
        forms += [f"{lead} {name}" for lead in ("SPDX-License-Identifier:", "under", "under the", "License:", *(("or", "and") if any(c.isdigit() for c in name) else ()))]
    return out


CUE = re.compile(
    r"licen[sc]e|\bcopyright\b|©|all rights reserved|permission (?:is hereby granted|to use)|redistribut|public domain|free software|creative commons|\bCC[ -]BY\b|\bCC0\b|SPDX|\bGPL|warrant(?:y|ies)\b|merchantability|\bsublicense\b|\b[AL]?GPLv?\d"
    rf"|\bunder (?:the |a )?(?:{'|'.join(sorted({re.escape(x.split()[0].lower()) for called in CALLED.values() for x in called}))})\b",
    re.I,
)
_STOP = re.compile(r"(?<!\bv)[.!?](?=\s|\Z)|\n|\Z")
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
#: Words that a wording may lack, or have otherwise, of every hundred; names and versions never.
TOLERANCE = 10
#: Whole texts are looked for by runs of so many words.
RUN = 5


#: Words that notices begin with.
LEADS = ("licensed", "released", "distributed", "available", "published", "provided")
#: Templates that save at least this share of what the best one saves are candidates.
NEAR = 0.6


def words_of(text: str) -> list[str]:
    return [_plain(w) for w in _WORD.findall(text.lower())]


def _plain(word: str) -> str:
    return word.replace("licence", "license")


#: Words that tell one licence from another.
NAMES = frozenset("mit apache gnu gpl lgpl agpl clause lesser affero bsd isc mozilla cc by nc nd sa cc0 creative commons attribution noncommercial noderivatives sharealike 1.0 2.0 3.0 4.0 2 3 unencumbered".split())
#: Those of them that are common words or list numbers in a whole text.
LIST_WORDS = frozenset("by 2 3".split())


def license_texts() -> dict[str, str]:
    """The whole texts in license_texts/ by licence."""
    from importlib.resources import files

    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")}


def spans_of(text: str) -> list[list[int]]:
    """Begin and end of the runs of neighbouring sentences with a cue; every cue of the text is in one of them.

    The text is only cut around cues: what lies between is never looked at sentence by sentence."""
    spans: list[list[int]] = []
    for cue in CUE.finditer(text):
        if spans and cue.end() <= spans[-1][1]:
            continue
        begin = max(text.rfind("\n", 0, cue.start()), *(text.rfind(mark, 0, cue.start()) for mark in (". ", "! ", "? ", ".\t"))) + 1
        end = _STOP.search(text, cue.end()).end()
        if spans and begin - spans[-1][1] <= 2:
            spans[-1][1] = end
        else:
            spans.append([begin, end])
    return spans


def blocks_of(text: str) -> list[str]:
    return [text[a:b].strip() for a, b in spans_of(text)]


def difference(block: list[str], form: list[str]) -> tuple[list[str], list[str]]:
    """(words that the block lacks, words that it has instead) against the stretch of it that aligns with ``form``."""
    from .html import common_lines

    pairs = common_lines(block, form)
    if not pairs:
        return form, []
    held = {j for _, j in pairs}
    used = {i for i, _ in pairs}
    stretch = range(pairs[0][0], pairs[-1][0] + 1)
    return [w for j, w in enumerate(form) if j not in held], [block[i] for i in stretch if i not in used]


def whole_texts(words: list[str], form: list[str], slack: int) -> list[tuple[int, int]]:
    """Stretches of ``words`` that may be the long ``form``, as the runs of five words that both have tell."""
    at: dict[tuple, list[int]] = {}
    for j in range(len(form) - RUN + 1):
        at.setdefault(tuple(form[j : j + RUN]), []).append(j)
    hits = sorted((i - j, i, j) for i in range(len(words) - RUN + 1) for j in at.get(tuple(words[i : i + RUN]), ()))
    out, near = [], []
    for hit in [*hits, (float("inf"), 0, 0)]:
        if near and hit[0] - near[-1][0] > slack:  # another copy of the text
            # runs that the form repeats lie on diagonals of their own, mostly alone
            if len({i for _, i, _ in near}) * RUN >= len(form) // 4:
                _, i, j = min(near, key=lambda x: x[1])
                _, k, m = max(near, key=lambda x: x[1])
                out.append((max(0, i - j), min(len(words), k + len(form) - m)))
            near = []
        near.append(hit)
    return out


class Scanner:
    def __init__(self, templates: dict[str, list[str]] | None = None):
        import zstandard as zstd

        templates, texts = wordings() if templates is None else templates, license_texts()
        self.plain = zstd.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.texts = {name: words_of(texts[name]) for name in templates if name in texts}
        self.forms, self.exact, self.with_template = {}, {}, {}
        for name, wording in templates.items():
            forms = sorted({tuple(words_of(f)) for f in wording})
            self.forms[name] = [list(f) for f in forms if len(f) * TOLERANCE >= 100]
            # short ones allow no difference: they are looked up by their first two words
            self.exact[name] = exact = {}
            for f in forms:
                if len(f) * TOLERANCE < 100:
                    exact.setdefault(f[:2], []).append(f)
            # what notices of all licences begin with stands in every dictionary, so that it favours none
            led = [(verb, *f) for f in forms if f[0] == "under" for verb in LEADS]
            whole = "\n".join(map(" ".join, [*([self.texts[name]] if name in self.texts else []), *forms, *led]))
            dictionary = zstd.ZstdCompressionDict(whole.encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=3)
            self.with_template[name] = zstd.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)

    def rank(self, words: list[str]) -> list[tuple[float, str]]:
        """Templates with the share of the words' compressed size that each saves, best first; ties by name."""
        raw = " ".join(words).encode("utf-8", "replace")
        alone = len(self.plain.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / alone, name) for name, c in self.with_template.items()), key=lambda x: (-x[0], x[1]))

    def candidates(self, words: list[str]) -> list[tuple[float, str]]:
        """The head of the ranking: what saves nearly as much as the best, and anything at all."""
        ranking = self.rank(words)
        return [(share, name) for share, name in ranking if share > 0 and share >= NEAR * ranking[0][0]]

    def identify(self, block: str) -> list[tuple[str, float, list[str], list[str]]]:
        """(licence, size reduction, missing words, other words) for every notice in the block, in the order of winning."""
        words = words_of(block)
        return [x[:4] for x in self._identify(words, 0, len(words))]

    def notices(self, text: str) -> tuple[int, list[tuple[str, str, float, list[str], list[str]]]]:
        """(number of blocks, (block, licence, size reduction, missing words, other words) for every notice).

        A wording begins in a block, or before it, and may go on behind it."""
        spans, out, seen = spans_of(text), [], []
        if not spans:
            return 0, []
        found = [(m.start(), _plain(m.group().lower())) for m in _WORD.finditer(text)]
        starts, words, known, far = [a for a, _ in found], [w for _, w in found], set(), 0
        for a, b in spans:
            begin, end = bisect_left(starts, a), bisect_left(starts, b)
            if end <= far:  # inside a text that was found
                continue
            block = text[a:b].strip()
            for name, share, missing, other, x, y in self._identify(words, begin, end):
                if (name, x, y) not in known:
                    known.add((name, x, y))
                    if x <= begin:
                        far = max(far, y)
                    out.append((block, name, share, missing, other))
        return len(spans), out

    def _identify(self, words: list[str], begin: int, end: int) -> list[tuple]:
        """What ``identify`` gives, and begin and end of the wording, for the block words[begin:end].

        A wording is confirmed if it lacks no name or version, and no more than TOLERANCE % of its words differ.  A
        notice that lies inside another one (of the same words) is not a second one."""
        out: dict[str, tuple] = {}
        left = list(range(begin, end))  # words that no notice explains
        while left:
            taken: set[int] = set()
            confirmed = []
            for share, name in self.candidates([words[i] for i in left]):
                confirmed += [(name, share, *x) for x in self._confirm(name, words, begin, end)]
            open_ = set(left)
            fresh = [c for c in confirmed if not open_.isdisjoint(range(c[4], c[5]))]
            # the same words are one notice: that of the longest wording, or of the first of the ranking
            fresh.sort(key=lambda c: (c[4] - c[5], len(c[2]) + len(c[3])))
            for c in fresh:
                own = set(range(c[4], c[5]))
                if own <= taken:
                    continue
                taken |= own
                best = out.get(c[0])
                if best is None or (len(c[2]) + len(c[3]), c[4] - c[5]) < (len(best[2]) + len(best[3]), best[4] - best[5]):
                    out[c[0]] = c
            if not taken & open_:
                break
            left = [i for i in left if i not in taken]
        return list(out.values())

    def _confirm(self, name: str, words: list[str], begin: int, end: int):
        """(missing words, other words, begin, end) of the licence's wordings that touch the block words[begin:end]."""
        exact = self.exact[name]
        low, high = max(0, begin - 100 // TOLERANCE), min(len(words), end + 100 // TOLERANCE)
        for x in range(low, min(high, end)):
            for f in exact.get(tuple(words[x : x + 2]), ()):
                y = x + len(f)
                if y > begin and tuple(words[x:y]) == f:
                    yield [], [], x, y
        for form, names, whole in [*((f, NAMES, False) for f in self.forms[name]), *((f, NAMES - LIST_WORDS, True) for f in [self.texts.get(name)] if f)]:
            allowed, found = len(form) * TOLERANCE // 100, []
            for x, y in self._stretches(words, begin, end, form, allowed, whole):
                missing, other = difference(words[x:y], form)
                if len(missing) <= allowed and len(other) <= allowed and not names & {*missing, *other}:
                    found.append((len(missing) + len(other), x, missing, other))
            for _, x, missing, other in sorted(found):
                if (y := min(high if not whole else len(words), x + len(form) - len(missing) + len(other))) > begin:
                    yield missing, other, x, y

    def _stretches(self, words: list[str], begin: int, end: int, form: list[str], allowed: int, whole: bool) -> list[tuple[int, int]]:
        """Stretches of the words that touch the block and may be the wording.

        A short wording may begin wherever one of its first words is, as many as it may lack and one more."""
        size = len(form) + allowed
        low, high = max(0, begin - size), min(len(words), end + size)
        region = words[low:high]
        if len(set(form) - set(region)) > allowed:
            return []
        if whole:
            found = [(low + x, low + y) for x, y in whole_texts(region, form, allowed)]
        else:
            first = set(form[: allowed + 1])
            found = [(low + x, min(high, low + x + size)) for x, w in enumerate(region) if w in first and len(set(form).difference(region[x : x + size])) <= allowed]
        return [(x, y) for x, y in found if x < end and begin < y]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_blocks (candidate blocks), licenses (sorted names), notices: an array of
    (block, license, reduction, missing, other), in order of the text.

    Null and empty texts have no block; very long ones are scanned whole, sentence by sentence around their cues.  Other
    columns are ignored; ids may be null or repeated, and rows that repeat are scanned each; an empty table gives an empty
    result.
    """
    from pyspark.sql import types as T

    notice = T.StructType([T.StructField("block", T.StringType()), T.StructField("license", T.StringType()), T.StructField("reduction", T.DoubleType()), T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("other", T.ArrayType(T.StringType()))])
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([picked.schema.fields[0], T.StructField("n_blocks", T.LongType()), T.StructField("licenses", T.ArrayType(T.StringType())), T.StructField("notices", T.ArrayType(notice))])

    def look(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        cache = worker_cache()
        if "licenses" not in cache:
            cache["licenses"] = Scanner()
        scanner: Scanner = cache["licenses"]
        for batch in pieces(batches):
            counts, names, notices = [], [], []
            for text in batch.column(1).to_pylist():
                n, notices_ = scanner.notices(text or "")
                found = [{"block": b, "license": name, "reduction": round(share, 6), "missing": missing, "other": other} for b, name, share, missing, other in notices_]
                counts.append(n)
                names.append(sorted({f["license"] for f in found}))
                notices.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(notices, to_arrow_type(T.ArrayType(notice)))], ["doc_id", "n_blocks", "licenses", "notices"])

    return picked.mapInArrow(look, schema)
