"""License scan: ordered signature rules behind a keyword prefilter.

A text becomes its words, lower-cased and joined by single blanks. One pass of a
keyword automaton tells which rules can match at all; only those regexes run.
Detections are settled by priority: one that lies inside an accepted detection
of the same or a higher priority is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from perfmine.llm.common import arrow_map, id_and_text
from perfmine.llm.words import folded_words

#: Phrases that are always reported, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label | keywords, one of which every match has | name of the license as a regex over normalised words
NAMES = """
apache-1.0 | apache | apache(?: software)? license(?: version)? 1 0
apache-1.1 | apache | apache(?: software)? license(?: version)? 1 1
apache-2.0 | apache | apache(?: software)? (?:license )?(?:version |v)?2(?: 0)?(?: license)?
mit | mit, expat | (?:mit|expat) (?:license|licence)
mit-0 | mit no | mit no attribution(?: license)?
bsd-2-clause | bsd | (?:bsd 2 clause|simplified bsd|two clause bsd|freebsd)(?: license)?
bsd-3-clause | bsd | (?:bsd 3 clause|new bsd|modified bsd|three clause bsd|revised bsd)(?: license)?
bsd-4-clause | bsd | (?:bsd 4 clause|original bsd|old bsd)(?: license)?
0bsd | bsd | (?:0bsd|zero clause bsd|bsd zero clause)(?: license)?
gpl-1.0 | gpl | (?:gnu )?gpl(?: version)? (?:v ?)?1(?: 0)?(?: only| or later)?
gpl-2.0 | gpl | (?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?(?: only| or later)?
gpl-3.0 | gpl | (?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?(?: only| or later)?
gpl-2.0 | general public | (?:gnu )?general public license (?:version |v ?)?2(?: 0)?
gpl-3.0 | general public | (?:gnu )?general public license (?:version |v ?)?3(?: 0)?
lgpl-2.0 | library general | (?:gnu )?library general public license
lgpl-2.1 | lesser | (?:gnu )?lesser general public license (?:version |v ?)?2 1
lgpl-3.0 | lesser | (?:gnu )?lesser general public license (?:version |v ?)?3(?: 0)?
lgpl | lgpl | (?:gnu )?lgpl ?(?:version |v ?)?(?:2 1|2|3)?(?: 0)?
agpl-3.0 | affero | (?:gnu )?affero general public license(?: (?:version |v ?)?3)?
agpl-3.0 | agpl | (?:gnu )?agpl ?(?:version |v ?)?3?(?: 0)?
gfdl | documentation license | (?:gnu )?free documentation license
mpl-1.1 | mozilla | mozilla public license (?:version |v ?)?1 1
mpl-2.0 | mozilla | mozilla public license (?:version |v ?)?2(?: 0)?
mpl-2.0 | mpl | mpl (?:version |v ?)?2(?: 0)?
epl-1.0 | eclipse | eclipse public license (?:version |v ?)?1(?: 0)?
epl-2.0 | eclipse | eclipse public license (?:version |v ?)?2(?: 0)?
cddl-1.0 | cddl | cddl(?: version)?(?: 1 0)?
cddl-1.0 | development and distribution | common development and distribution license
cpl-1.0 | common public | common public license(?: (?:version |v ?)?1(?: 0)?)?
eupl-1.1 | eupl | eupl (?:version |v ?)?1 1
eupl-1.2 | eupl | eupl (?:version |v ?)?1 2
eupl | european union public | european union public licen[cs]e
isc | isc | isc license
zlib | zlib | zlib(?: libpng)? license
libpng | libpng | libpng license
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl, do what the f | (?:wtfpl|do what the f\\w* you want to public license)
boost-1.0 | boost | boost software license(?: (?:version )?1 0)?
artistic-1.0 | artistic | artistic license 1 0
artistic-2.0 | artistic | artistic license (?:version )?2(?: 0)?
perl | perl | same terms as perl(?: itself)?
python-2.0 | python, psf | (?:psf|python(?: software foundation)?) license(?: (?:version )?2)?
php-3.01 | php | php license(?: version)? 3 01
ruby | ruby | ruby license
openssl | openssl | openssl license
ssleay | ssleay | ssleay license
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? license
postgresql | postgresql | postgresql licen[cs]e
ofl-1.1 | open font | (?:sil )?open font license(?: (?:version )?1 1)?
ms-pl | microsoft | microsoft public license
ms-rl | microsoft | microsoft reciprocal license
osl-3.0 | open software license | open software license(?: (?:version |v ?)?3(?: 0)?)?
afl-3.0 | academic free | academic free license(?: (?:version |v ?)?3(?: 0)?)?
ecl-2.0 | educational | educational community license(?: (?:version )?2(?: 0)?)?
upl-1.0 | universal permissive | universal permissive license
sspl-1.0 | server side | server side public license
busl-1.1 | business source | business source license(?: 1 1)?
elastic-2.0 | elastic | elastic license(?: 2 0)?
commons-clause | commons clause | commons clause
beerware | beer | beer ?ware license
vim | vim | vim license
x11 | x11 | x11 license
w3c | w3c | w3c software(?: notice and)? license
icu | icu | icu license
unicode | unicode | unicode(?: inc)? license agreement
odbl-1.0 | open database | open database license(?: (?:version |v ?)?1 0)?
odc-by | attribution license | open data commons attribution license
pddl-1.0 | public domain dedication | public domain dedication and license
ogl-3.0 | open government | open government licence(?: v ?3 0)?
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | creative commons zero | creative commons zero
cc-by-2.0 | cc by | cc by 2 0
cc-by-3.0 | cc by | cc by 3 0
cc-by-4.0 | cc by | cc by 4 0
cc-by-sa-3.0 | cc by | cc by sa 3 0
cc-by-sa-4.0 | cc by | cc by sa 4 0
cc-by-sa | cc by | cc by sa
cc-by-nd | cc by | cc by nd(?: [1-4] 0)?
cc-by-nc | cc by | cc by nc(?: [1-4] 0)?
cc-by-nc-sa | cc by | cc by nc sa(?: [1-4] 0)?
cc-by-nc-nd | cc by | cc by nc nd(?: [1-4] 0)?
cc-by | creative commons | creative commons attribution(?: [1-4] 0)?(?: international| unported)?
cc-by-sa | creative commons | creative commons attribution share ?alike(?: [1-4] 0)?
cc-by-nc | creative commons | creative commons attribution non ?commercial(?: [1-4] 0)?
cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] 0)?
proprietary | proprietary | (?:proprietary and confidential|confidential and proprietary)
public-domain | public domain | (?:released into|placed in|dedicated to|in) the public domain
"""

#: label | keywords | sentence of a license text or notice, as a regex over normalised words
TEXTS = """
mit | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy
isc | permission to use | permission to use copy modify and or distribute this software for any purpose
bsd-2-clause | redistributions | redistributions of source code must retain the above copyright notice
bsd-3-clause | endorse or promote | may be used to endorse or promote products derived from this software
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software
warranty | as is | the software is provided as is without warranty of any kind
warranty | merchantability | implied warrant(?:y|ies) of merchantability (?:and|or) fitness for a particular purpose
gpl | redistribute it | you can redistribute it and or modify it under the terms of the gnu
apache-2.0 | limitations under | see the license for the specific language governing permissions and limitations under
mpl-2.0 | this source code form | this source code form is subject to the terms of the mozilla public license
zlib | origin of this software | the origin of this software must not be misrepresented
unlicense | unencumbered | free and unencumbered software released into the public domain
boost-1.0 | machine executable | machine executable object code generated by a source language processor
copyright | copyright | copyright(?: c)? (?:19|20)[0-9]{2}
no-redistribution | redistribution, reproduction | (?:no|unauthorized) (?:redistribution|reproduction)
permission-required | permission | without (?:the )?(?:prior )?(?:express )?(?:written )?permission
"""

#: form of a rule | regex around the name | priority | confidence
FORMS = (
    ("tag", "spdx license identifier {0}", 100, 0.98),
    ("grant", "(?:licensed|released|distributed|available|covered|published) (?:under|by)(?: the)?(?: terms of)?(?: the)? {0}", 80, 0.9),
    ("field", "licen[cs]e(?: is)?(?: the)? {0}", 70, 0.85),
    ("name", "{0}", 50, 0.7),
)
TEXT_PRIORITY, TEXT_CONFIDENCE, BASE_PRIORITY, BASE_CONFIDENCE = 90, 0.8, 30, 0.6


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str
    regex: str
    priority: int
    confidence: float
    base: bool = False


def _lines(block: str) -> Iterator[tuple[str, str, str]]:
    for line in block.strip().splitlines():
        label, keyword, regex = (x.strip() for x in line.split(" | ", 2))
        yield label, keyword, regex.replace("\\\\", "\\")


def default_rules() -> list[Rule]:
    """All rules, highest priority first."""
    rules = [Rule(f"base:{label}", label, phrase, re.escape(phrase).replace("\\ ", " "), BASE_PRIORITY, BASE_CONFIDENCE, True) for phrase, label in BASE.items()]
    for label, keyword, name in _lines(NAMES):
        rules += [Rule(f"{form}:{label}", label, keyword, around.format(f"(?:{name})"), priority, sure) for form, around, priority, sure in FORMS]
    rules += [Rule(f"text:{label}", label, keyword, text, TEXT_PRIORITY, TEXT_CONFIDENCE) for label, keyword, text in _lines(TEXTS)]
    return sorted(rules, key=lambda r: -r.priority)


class Scanner:
    """The rules made ready for use in one worker."""

    def __init__(self, rules: list[Rule]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for i, rule in enumerate(rules):
            for keyword in rule.keyword.split(", "):
                by_keyword.setdefault(keyword, []).append(i)
        for keyword, which in by_keyword.items():
            self.automaton.add_word(keyword, which)
        self.automaton.make_automaton()
        self.rules = [(r, re.compile(rf"(?<![^ ]){r.regex}(?![^ ])")) for r in rules]

    def scan(self, text: str) -> tuple[int, list[tuple]]:
        """Number of words and (label, rule, priority, confidence, first word, end word, base)."""
        words = folded_words(text)
        flat = b" ".join(words).decode()
        live = {i for _, which in self.automaton.iter(flat) for i in which}
        matches = [(rule, *m.span()) for rule, regex in map(self.rules.__getitem__, sorted(live)) for m in regex.finditer(flat)]
        if not matches:
            return len(words), []
        # a place's word number is the number of blanks before it
        blanks = np.flatnonzero(np.frombuffer(flat.encode("utf-32-le"), dtype="<u4") == ord(" "))
        starts, ends = (np.searchsorted(blanks, [m[k] for m in matches]).tolist() for k in (1, 2))
        return len(words), settled([(m[0], a, b + 1) for m, a, b in zip(matches, starts, ends, strict=True)])


def settled(found: list[tuple[Rule, int, int]]) -> list[tuple]:
    """Accept by priority, then length, then place; drop what an accepted one contains.

    Detections that overlap without containment are both kept.

    Base phrases are all kept and suppress nothing.
    """
    # accepted spans that no other accepted one contains: both lists rise
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for rule, start, end in sorted(found, key=lambda d: (-d[0].priority, d[1] - d[2], d[1], d[0].name)):
        if not rule.base:
            at = bisect_right(starts, start)
            if at and ends[at - 1] >= end:
                continue
            low, high = bisect_left(starts, start), bisect_right(ends, end)
            starts[low:high], ends[low:high] = [start], [end]
        out.append((rule.label, rule.name, rule.priority, rule.confidence, start, end, rule.base))
    return sorted(out, key=lambda d: (d[4], d[5], d[1]))


_DETECTION = "struct<label:string,rule:string,priority:int,confidence:double,start:long,end:long,base:boolean>"


def license_detections(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, detections) of every row; positions are word numbers from 0.

    ``detections`` is sorted by place and empty where nothing is found. Null and
    empty texts have no words. A null id is kept, repeated rows are scanned each.
    """
    rules = default_rules() if rules is None else rules

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scanner = Scanner(rules)
        keys = ("label", "rule", "priority", "confidence", "start", "end", "base")
        for batch in batches:
            scanned = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield {
                "doc_id": batch.column(0),
                "n_words": [n for n, _ in scanned],
                "detections": [[dict(zip(keys, d, strict=True)) for d in found] for _, found in scanned],
            }

    return arrow_map(id_and_text(docs), work, f"doc_id long, n_words long, detections array<{_DETECTION}>")
