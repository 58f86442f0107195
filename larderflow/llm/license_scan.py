"""Licence scan: texts are brought to one canonical form, and its digest is looked up among those of known licences.

Canonical form: A-Z in lower case, copyright notices dropped, equivalent spellings made one, everything but letters and
digits turned into single spaces. Whole texts are looked up, and each line of a text as a text of its own, which finds
one-line notices. Only DataFrame functions are used.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from importlib.resources import files
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words that follow "copyright" or, in a list, "(c)" in running text; other words there are names.
PROSE = (
    "a about above accompany act acts additional after against all also an and any applicable applies are as assign at attribution be because "
    "before belongs by can cannot cause certain claim claims clearance complete comply conditions convey copy covered disclaimer disclaimers "
    "distribute doctrine doctrines do does each either ensure every except exceptions exclusively exists expires for from give grant grants has have holder "
    "holders if in include includes including infringement infringements inform information interest interests into is it its keep law laws "
    "legislation libraries license licensed licensee licenses licensing licensor limit limitation line lines make management marks material "
    "materials may means must neither no nor not notice notices of offer office on or other otherwise owned owner owners ownership patent "
    "permission permits policy prevent property protected protection provide provisions publish registration remains reproduce resulting "
    "retain right rights section sections shall should similar statement statements status subsist such term terms than that the then there these "
    "this those to trademark treaties treaty under unless use violation waiver was when where whether which who will with within without work "
    "works would you your licence licences licenced licencee"
).split()


def _not_among(words: list[str]) -> str:
    """A pattern of a word of a-z that is none of ``words``, without looking ahead; empty words stand for an end here."""
    first = sorted({w[0] for w in words if w})
    others = "".join(c for c in LOWER if c not in first)
    parts = [] if "" in words else [r"\b"]
    parts += [f"[{others}][a-z]*\\b"] if others else []
    return f"(?:{'|'.join(parts + [c + _not_among([w[1:] for w in words if w[:1] == c]) for c in first])})"


_NAME = rf"(?:[\x{{C0}}-\x{{1FFF}}]|{_not_among([*PROSE, ''])}|the [^\n]*\b(?:authors|contributors|developers|foundation|project|regents|team|university)\b)"
# A notice: the word or sign, and then a sign, a year, a blank to fill in or a name; or the reservation of rights as a sentence.
COPYRIGHT = (
    r"(^|\n)[ \t]*(?:(?:copyright[ \t]*:?[ \t]*(?:\(c\)|©|&copy;|[0-9\[<{])|(?:\(c\)|©)[ \t]*(?:copyright\b|[0-9\[<{])"
    rf"|(?:copyright(?:[ \t]*:[ \t]*|[ \t]+)|(?:\(c\)|©)[ \t]*){_NAME}|all rights reserved[ \t]*[.,;!])[^\n]*|all rights reserved[ \t]*(?m:$))"
)
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{A0}-\x{BF}\x{2010}-\x{2027}\x{2030}-\x{205E}]+"
# Spellings that licence texts use for the same word. What is written as one word or as two becomes two, and no
# pair has two words on its left, so the form of a text does not depend on where its lines are broken.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sub license"),
    ("sublicense", "sub license"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelation", "cancellation"),
    ("centre", "center"),
    ("owner", "holder"),
    ("owners", "holders"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("merchantibility", "merchantability"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognised", "recognized"),
    ("utilisation", "utilization"),
    ("while", "whilst"),
    ("wilful", "willful"),
    ("percent", "per cent"),
    ("https", "http"),
)

_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software.\n" + _DISCLAIMER
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_DISCLAIMER
)
_0BSD = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
    + _ISC_DISCLAIMER
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE {by} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE {of} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
    "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)


def _titled(titles: tuple[str, ...], *texts: str) -> tuple[str, ...]:
    """Each text without a title and under each of its usual ones."""
    return tuple(f"{title}\n{text}" if title else text for title, text in product(("", *titles), texts))


def _whole(name: str, *cuts: str, heads: int = 0) -> tuple[str, ...]:
    """The text in the file of that name from line ``heads`` on, and, for each of ``cuts``, what stands before that line."""
    lines = files("larderflow.llm").joinpath("licences", f"{name}.txt").read_text("utf-8").split("\n")[heads:]
    ends = [len(lines), *(next(k for k, line in enumerate(lines) if line.strip().startswith(cut)) for cut in cuts)]
    return tuple("\n".join(lines[:end]) for end in ends)


def _bsd(clauses: int) -> tuple[str, ...]:
    """With numbers or bullets, and the wordings in use of the third clause and of who disclaims."""
    given = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of {whose} nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.",
    )
    wordings = [("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER", "the copyright holder"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS", "the copyright holder")]
    wordings += [("REGENTS", "REGENTS", "the University")] if clauses == 3 else [("AUTHOR", "AUTHOR", "")]
    out = []
    for (by, of, whose), marks in product(wordings, (("1.", "2.", "3."), ("*", "*", "*"))):
        listed = [f"{mark} {clause}" for mark, clause in zip(marks, given[1 : clauses + 1], strict=False)]
        out.append("\n".join([given[0], *listed, _BSD_DISCLAIMER]).format(by=by, of=of, whose=whose))
    return tuple(out)


def _gpl2() -> tuple[str, ...]:
    """With the addresses that the Free Software Foundation has had, with and without what stands after the terms."""
    told = _whole("GPL-2.0", "How to Apply These Terms", heads=3)
    new, old = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301", "59 Temple Place, Suite 330, Boston, MA  02111-1307"
    return (*told, *(t.replace(new, f"{new},") for t in told), *(t.replace(new, old) for t in told), *(t.replace(f" {new} USA\n", "", 1) for t in told[1:]))


def _creative_commons(name: str) -> tuple[str, ...]:
    """With and without the words about the licence before and after it."""
    whole = _whole(name, heads=1)[0]
    bare = re.sub(r"(?s)^.*?\n(?=Creative Commons Attribution[^\n]*Public\s+License\n)", "", whole)
    return tuple(t for some in (whole, bare) for t in (some, re.sub(r"(?s)\n=+\s+Creative Commons is not a party.*", "", some)))


# Texts of licences and one-line notices, by SPDX name. A licence may have several texts. CC-BY-NC-4.0 has no
# whole text here; ``known_digests`` takes other texts as well.
LICENCES: Mapping[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\").",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        *_titled(
            ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "Apache License\nVersion 2.0, January 2004"),
            *_whole("Apache-2.0", "APPENDIX: How to apply", "END OF TERMS", heads=4),
        ),
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        *_titled(("The MIT License", "The MIT License (MIT)", "MIT License (MIT)"), _MIT),
        "MIT License\n" + _MIT,
    ),
    "ISC": (
        "SPDX-License-Identifier: ISC",
        *_titled(("ISC License", "The ISC License", "ISC License (ISC)"), _ISC, _ISC.replace("and/or", "and")),
    ),
    "0BSD": (
        "SPDX-License-Identifier: 0BSD",
        *_titled(("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD License (0BSD)"), _0BSD),
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        *_titled(
            ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "3-Clause BSD License", "New BSD License", "BSD License",
             'BSD 3-Clause "New" or "Revised" License', "Modified BSD License"),
            *_bsd(3),
        ),
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        *_titled(
            ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "2-Clause BSD License", "Simplified BSD License",
             'BSD 2-Clause "Simplified" License', "BSD License"),
            *_bsd(2),
        ),
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        *_titled(("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007",), *_whole("GPL-3.0", "How to Apply These Terms", heads=3)),
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        *_titled(("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991",), *_gpl2()),
    ),
    "MPL-2.0": (
        "This work is licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        *_titled(("Mozilla Public License Version 2.0",), *_whole("MPL-2.0", "Exhibit A - Source", heads=2)),
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        *_titled(("Attribution 4.0 International", "Creative Commons Attribution 4.0 International"), *_creative_commons("CC-BY-4.0")),
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        *_titled(
            ("Attribution-ShareAlike 4.0 International", "Creative Commons Attribution-ShareAlike 4.0 International"), *_creative_commons("CC-BY-SA-4.0")
        ),
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC0-1.0": (
        "Released under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
        *_titled(
            ("CC0 1.0 Universal", "Creative Commons Legal Code\nCC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"),
            *_whole("CC0-1.0", heads=4), *_whole("CC0-1.0", heads=13),
        ),
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        *_titled(("The Unlicense", "Unlicense"), *_whole("Unlicense"), *_whole("Unlicense", "For more information")),
    ),
}


def canonical_lines(text: str) -> Column:
    """The canonical form of each line; empty lines are dropped, null gives none."""
    said = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    said = F.regexp_replace(F.replace(said, F.lit("\r"), F.lit("\n")), COPYRIGHT, "\n")
    said = F.regexp_replace(said, PUNCTUATION, " ")
    lines = F.transform(F.split(said, "\n"), lambda line: F.trim(line))
    return F.transform(F.filter(lines, lambda line: line != ""), _spelt)


def _spelt(line: Column) -> Column:
    """Equivalent spellings as whole words: a space is put on both sides of the line, and taken off again."""
    padded = F.concat(F.lit(" "), line, F.lit(" "))
    for one, other in SPELLINGS:
        padded = F.replace(padded, F.lit(f" {one} "), F.lit(f" {other} "))
    return F.trim(padded)


def known_digests(spark: SparkSession, licences: Mapping[str, tuple[str, ...]] = LICENCES) -> DataFrame:
    """(digest, licence), each digest once; of two licences with one text the first by name counts.

    The digests are taken once, by the expressions that the documents go through, so no plan carries whole texts along.
    """
    rows = [F.struct(F.lit(name).alias("licence"), F.lit(text).alias("text")) for name, texts in licences.items() for text in texts]
    told = spark.range(1).select(F.inline(F.array(*rows)))
    digest = F.md5(F.array_join(canonical_lines("text"), " "))
    taken = told.select(digest.alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence")).collect()
    pairs = [F.struct(F.lit(r.digest).alias("digest"), F.lit(r.licence).alias("licence")) for r in sorted(taken)]
    return spark.range(1).select(F.inline(F.array(*pairs)))


def scan(docs: DataFrame, known: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``digest`` of the whole canonical text, ``licence`` it is the text of (else null),
    ``line_licences`` (names, sorted, joined by commas; null if no line is a known text) and ``n_lines`` of such lines.

    A null or empty text, or one of copyright notices and punctuation only, has the digest of the empty text and no licence.
    Rows with null ids and repeated rows all come back. Other columns are not read; an empty table gives no rows.

    The canonical form of a text is taken once; the digests that come out are written as a narrow table, which both joins
    read. Lines are grouped by the digest of the text they stand in, so copies are counted once and joined back; ``known`` may
    be of any size, Spark broadcasts it only if it is small.
    """
    told = written(_digests(docs, id, text), "digests")
    whole = told.select(id, "key", F.col("told.digest").alias("digest"))
    # The outer form keeps Spark from asking for the size of the lines below the explode.
    lines = told.select("key", F.posexplode_outer("told.lines").alias("at", "line")).select("key", "at", F.lower(F.hex("line")).alias("digest"))
    found = lines.join(known, "digest").groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("line_licences"),
        F.size(F.collect_set("at")).cast("long").alias("n_lines"),
    )
    return whole.join(known, "digest", "left").join(found, "key", "left").select(
        id, "digest", "licence", "line_licences", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines")
    )


def _digests(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, key, told): ``key`` is of the text as it is, ``told`` holds the digest of its canonical form and of each canonical line.

    The lines are bound by a lambda, so that their form is taken once for both.
    """
    both = lambda lines: F.struct(
        F.md5(F.array_join(lines, " ")).alias("digest"), F.transform(lines, lambda line: F.unhex(F.md5(line))).alias("lines")
    )
    told = F.element_at(F.transform(F.array(canonical_lines(text)), both), 1)
    return docs.select(F.col(id), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("key"), told.alias("told"))
