"""License scan: ordered signature rules with keyword prefilter and overlap resolution.

A rule is (priority, label, keywords, regex) over a text's words, lower-cased in A-Z and joined by single
spaces ("version 2.0" reads "version 2 0"). A rule is tried only if all its keywords are among the words.
Detections that overlap are resolved: one that lies inside a longer one is suppressed, of several on the
same words the one of best priority stays, and of two that cross each other likewise. So "gnu lesser
general public license version 2 1" is neither the general license nor version 2. Base phrases are never
suppressed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, rows_in_chunks, words_alnum

#: Phrases whose every place counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_V = r"(?: version| v| ver)? ?"
_LATER = r"(?: only| or (?:any )?later(?: version)?| or \(?at your option\)? any later version)?"
#: label | keywords | regex. {v} is the optional word "version".
_RULES = r"""
apache-1.0 | apache | apache(?: software)? licen[sc]e{v}1 0
apache-1.1 | apache | apache(?: software)? licen[sc]e{v}1 1
apache-2.0 | apache | apache(?: software)? licen[sc]e{v}2(?: 0)?
apache-2.0 | apache | (?:licen[sc]ed under|under) the apache licen[sc]e
apache-2.0 | apache | www apache org licen[sc]es license 2 0
apache-2.0 | apache | apache 2(?: 0)?(?: licen[sc]e)?
apache-2.0 | spdx apache | spdx license identifier apache 2 0
apache | apache | apache licen[sc]e
mit | mit | (?:the )?mit licen[sc]e
mit | mit | licen[sc]ed under (?:the )?mit
mit | mit | spdx license identifier mit
mit | mit | opensource org licenses mit(?: license)?
mit | permission granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | mit attribution | mit no attribution(?: licen[sc]e)?
mit-0 | mit | mit 0
x11 | x11 | x11 licen[sc]e
expat | expat | expat licen[sc]e
isc | isc | isc licen[sc]e
isc | isc | spdx license identifier isc
isc | permission fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-2-clause | bsd | (?:simplified|2 clause|two clause|freebsd) bsd(?: licen[sc]e)?
bsd-2-clause | bsd | bsd (?:2|two) clause(?: (?:simplified )?licen[sc]e)?
bsd-3-clause | bsd | (?:new|modified|revised|3 clause|three clause) bsd(?: licen[sc]e)?
bsd-3-clause | bsd | bsd (?:3|three) clause(?: (?:new or revised )?licen[sc]e)?
bsd-4-clause | bsd | (?:original|old|4 clause|four clause) bsd(?: licen[sc]e)?
bsd-4-clause | bsd | bsd (?:4|four) clause(?: licen[sc]e)?
bsd-4-clause | advertising acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clause | endorse promote | neither the name of .{{1,80}}? may be used to endorse or promote products derived from this software
bsd | bsd | bsd licen[sc]e
bsd | bsd | bsd style licen[sc]e
bsd | redistribution binary | redistribution and use in source and binary forms with or without modification are permitted
0bsd | bsd | (?:zero clause bsd|bsd zero clause)(?: licen[sc]e)?
0bsd | 0bsd | 0bsd(?: licen[sc]e)?
artistic-1.0 | artistic | artistic licen[sc]e{v}1 0
artistic-2.0 | artistic | artistic licen[sc]e{v}2(?: 0)?
artistic | artistic | artistic licen[sc]e
zlib | zlib | zlib(?: libpng)? licen[sc]e
libpng | libpng | libpng licen[sc]e
unlicense | unlicense | (?:the )?unlicense(?: org)?
unlicense | unencumbered domain | this is free and unencumbered software released into the public domain
wtfpl | wtfpl | wtfpl(?: version 2)?
wtfpl | want | do what the (?:fuck|f\w*) you want to public licen[sc]e
boost-1.0 | boost | boost software licen[sc]e(?:{v}1 0)?
boost-1.0 | bsl | bsl 1 0
postgresql | postgresql | postgresql licen[sc]e
python-2.0 | python | python software foundation licen[sc]e(?:{v}2)?
python-2.0 | psf | psf licen[sc]e(?: agreement)?
php-3.0 | php | php licen[sc]e{v}3 0
php-3.01 | php | php licen[sc]e{v}3 01
php | php | php licen[sc]e
ruby | ruby | ruby(?: s)? licen[sc]e
perl | perl | same terms as perl(?: itself)?
openssl | openssl | openssl licen[sc]e
openssl | ssleay | original ssleay licen[sc]e
curl | curl | curl licen[sc]e
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e
vim | vim | vim licen[sc]e
w3c | w3c | w3c(?: software)?(?: notice and)? licen[sc]e
json | json | json licen[sc]e
json | good evil | the software shall be used for good not evil
beerware | beerware | beerware(?: licen[sc]e)?
beerware | beer | the beer ware licen[sc]e
icu | icu | icu licen[sc]e
unicode | unicode | unicode(?: inc)? licen[sc]e(?: agreement)?
ofl-1.0 | ofl | (?:sil )?ofl{v}1 0
ofl-1.1 | ofl | (?:sil )?ofl{v}1 1
ofl-1.1 | sil font | sil open font licen[sc]e(?:{v}1 1)?
ms-pl | microsoft | microsoft public licen[sc]e
ms-rl | microsoft | microsoft reciprocal licen[sc]e
ms-pl | ms pl | ms pl
sleepycat | sleepycat | sleepycat licen[sc]e
qpl-1.0 | public | q public licen[sc]e(?:{v}1 0)?
nokia | nokia | nokia open source licen[sc]e
ibm-public-1.0 | ibm | ibm public licen[sc]e(?:{v}1 0)?
cpl-1.0 | common | common public licen[sc]e(?:{v}1 0)?
cpal-1.0 | common attribution | common public attribution licen[sc]e(?:{v}1 0)?
osl-3.0 | open | open software licen[sc]e(?:{v}3 0)?
afl-3.0 | academic | academic free licen[sc]e(?:{v}3 0)?
ecl-2.0 | educational | educational community licen[sc]e(?:{v}2 0)?
upl-1.0 | universal | universal permissive licen[sc]e(?:{v}1 0)?
eupl-1.1 | eupl | eupl{v}1 1
eupl-1.2 | eupl | eupl{v}1 2
eupl | european union | european union public licen[sc]e
cecill-2.1 | cecill | cecill{v}2 1
cecill | cecill | cecill(?: (?:b|c))?(?: licen[sc]e)?
mpl-1.0 | mozilla | mozilla public licen[sc]e{v}1 0
mpl-1.1 | mozilla | mozilla public licen[sc]e{v}1 1
mpl-2.0 | mozilla | mozilla public licen[sc]e{v}2(?: 0)?
mpl-1.1 | mpl | mpl{v}1 1
mpl-2.0 | mpl | mpl{v}2(?: 0)?
mpl-2.0 | mozilla | mozilla org mpl 2 0
mpl | mozilla | mozilla public licen[sc]e
epl-1.0 | eclipse | eclipse public licen[sc]e{v}1(?: 0)?
epl-2.0 | eclipse | eclipse public licen[sc]e{v}2(?: 0)?
epl-1.0 | epl | epl{v}1 0
epl-2.0 | epl | epl{v}2 0
epl | eclipse | eclipse public licen[sc]e
edl-1.0 | eclipse | eclipse distribution licen[sc]e(?:{v}1 0)?
cddl-1.0 | cddl | cddl{v}1 0
cddl-1.1 | cddl | cddl{v}1 1
cddl | common distribution | common development and distribution licen[sc]e
cddl | cddl | cddl
sspl-1.0 | server side | server side public licen[sc]e(?:{v}1)?
sspl-1.0 | sspl | sspl(?:{v}1(?: 0)?)?
busl-1.1 | business source | business source licen[sc]e(?:{v}1 1)?
busl-1.1 | busl | busl{v}1 1
elastic-2.0 | elastic | elastic licen[sc]e(?:{v}2(?: 0)?)?
confluent-1.0 | confluent | confluent community licen[sc]e(?:{v}1 0)?
commons-clause | commons clause | commons clause(?: licen[sc]e)?(?: condition)?
polyform | polyform | polyform (?:noncommercial|shield|strict|small business|internal use|free trial|perimeter) licen[sc]e(?: 1 0 0)?
fair-source | fair source | fair source licen[sc]e
hippocratic | hippocratic | hippocratic licen[sc]e(?:{v}[23] \d)?
blueoak-1.0.0 | blue oak | blue oak model licen[sc]e(?: 1 0 0)?
mulan-2.0 | mulan | mulan (?:permissive software licen[sc]e|psl)(?:{v}2)?
openrail | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[sc]e)?
openrail | open rail | (?:creativeml |bigscience |bigcode )?open rail(?: m)?(?: licen[sc]e)?
openrail | responsible ai | responsible ai licen[sc]e
odbl-1.0 | odbl | odbl(?:{v}1 0)?
odbl-1.0 | database | open (?:data commons )?open database licen[sc]e
odbl-1.0 | database | open database licen[sc]e
odc-by-1.0 | attribution commons | open data commons attribution licen[sc]e(?:{v}1 0)?
odc-by-1.0 | odc | odc by(?: 1 0)?
pddl-1.0 | pddl | pddl(?: 1 0)?
pddl-1.0 | domain dedication | public domain dedication and licen[sc]e
cdla-permissive | cdla | cdla permissive(?: [12] 0)?
cdla-sharing | cdla | cdla sharing(?: 1 0)?
ogl-uk-3.0 | ogl | ogl uk(?: 3 0)?
ogl-uk-3.0 | government | open government licen[sc]e(?:{v}3 0)?
etalab-2.0 | etalab | (?:licence ouverte )?etalab(?: 2 0)?
dl-de-by-2.0 | datenlizenz | datenlizenz deutschland(?: namensnennung)?(?:{v}2 0)?
gfdl | documentation | gnu free documentation licen[sc]e(?:{v}1 [123])?
gfdl | gfdl | gfdl(?:{v}1 [123])?
fal-1.3 | art libre | licence art libre(?:{v}1 3)?
fal-1.3 | free art | free art licen[sc]e(?:{v}1 3)?
public-domain | public domain | (?:released|placed|dedicated|is) (?:in|into|to) the public domain
public-domain | public domain | public domain
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | creative zero | creative commons zero
cc0-1.0 | publicdomain zero | creativecommons org publicdomain zero(?: 1 0)?
cc-pdm | domain mark | public domain mark(?: 1 0)?
cc | creative commons | creative commons(?: licen[sc]e)?
cc | commons licence | licence creative commons
proprietary | proprietary | proprietary and confidential
proprietary | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
proprietary | confidential | strictly confidential
proprietary | part reproduced | no part of this (?:publication|work|document|book) may be reproduced
proprietary | permission written | without (?:the )?(?:prior )?(?:express )?written permission
proprietary | internal only | for internal use only
proprietary | user agreement | end user licen[sc]e agreement
proprietary | eula | eula
copyright | copyright | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)?\d\d)?
copyright | © | © (?:19|20)\d\d
copyright | copyright | copyright holders?
reserved | alle rechte | alle rechte vorbehalten
reserved | tous droits | tous droits réservés
reserved | todos derechos | todos los derechos reservados
reserved | rights | no rights reserved
warranty | warranty | the software is provided as is without warranty of any kind
warranty | warranty | without even the implied warranty of merchantability
aal | attribution assurance | attribution assurance licen[sc]e
adobe-2006 | adobe | adobe systems incorporated source code licen[sc]e agreement
aladdin | aladdin | aladdin free public licen[sc]e
apsl-2.0 | apple | apple public source licen[sc]e(?:{v}2 0)?
apple-sample | apple sample | apple sample (?:source )?code licen[sc]e
bittorrent | bittorrent | bittorrent open source licen[sc]e
bzip2 | bzip2 | bzip2 (?:and libbzip2 )?licen[sc]e
catosl-1.1 | computer associates | computer associates trusted open source licen[sc]e
cern-ohl | cern | cern open hardware licen[sc]e(?:{v}[12](?: [012])?)?
cern-ohl | cern ohl | cern ohl(?: (?:p|w|s))?
cua-opl | cua | cua office public licen[sc]e
d-fsl-1.0 | freie | deutsche freie software lizenz
ecos-2.0 | ecos | ecos licen[sc]e(?:{v}2 0)?
efl | eiffel | eiffel forum licen[sc]e(?:{v}[12])?
fair | fair | fair licen[sc]e
freetype | freetype | freetype (?:project )?licen[sc]e
gemma | gemma | gemma terms of use
giftware | giftware | giftware licen[sc]e
gsoap | gsoap | gsoap public licen[sc]e
hpnd | historical disclaimer | historical permission notice and disclaimer
imagemagick | imagemagick | imagemagick licen[sc]e
info-zip | info zip | info zip licen[sc]e
ipa | ipa | ipa font licen[sc]e
jasper | jasper | jasper licen[sc]e
lppl | latex | latex project public licen[sc]e(?:{v}1 [0-3]c?)?
lppl | lppl | lppl
libtiff | libtiff | libtiff licen[sc]e
llama | llama | (?:meta )?llama [234](?: [123])? community licen[sc]e(?: agreement)?
lucent-1.02 | lucent | lucent public licen[sc]e(?:{v}1 02)?
nasa-1.3 | nasa | nasa open source agreement(?:{v}1 3)?
ntp | ntp | ntp licen[sc]e
nvidia | nvidia | nvidia (?:software |open model )?licen[sc]e(?: agreement)?
oldap | openldap | openldap public licen[sc]e(?:{v}2 \d)?
open-game | game | open game licen[sc]e(?:{v}1 0a?)?
oracle-bcl | oracle | oracle binary code licen[sc]e agreement
oracle-nftc | oracle | oracle no fee terms and conditions
oset | oset | oset public licen[sc]e
parity | parity | parity public licen[sc]e(?: [67] 0 0)?
prosperity | prosperity | prosperity public licen[sc]e(?: [23] 0 0)?
rpl-1.5 | reciprocal | reciprocal public licen[sc]e(?:{v}1 [15])?
rpsl-1.0 | realnetworks | realnetworks public source licen[sc]e
simpl-2.0 | simple | simple public licen[sc]e(?:{v}2 0)?
sissl | sun industry | sun industry standards source licen[sc]e
spl-1.0 | sun | sun public licen[sc]e(?:{v}1 0)?
solderpad | solderpad | solderpad hardware licen[sc]e(?:{v}[02] [0-9]+)?
tapr-ohl | tapr | tapr open hardware licen[sc]e
tcl | tcl | tcl(?: tk)? licen[sc]e
ubuntu-font | ubuntu | ubuntu font licen[sc]e(?:{v}1 0)?
bitstream-vera | bitstream | bitstream vera fonts? copyright
vsl-1.0 | vovida | vovida software licen[sc]e
watcom-1.0 | watcom | (?:sybase )?open watcom public licen[sc]e
wordnet | wordnet | wordnet(?: 3 0)? licen[sc]e
zpl | zope | zope public licen[sc]e(?:{v}[12] [01])?
anti-996 | 996 | anti 996 licen[sc]e
copyleft-next | copyleft | copyleft next(?: 0 3 [01])?
cc-sampling | sampling | creative commons sampling(?: plus)?(?: 1 0)?
cc-devnations | developing nations | creative commons developing nations
community-data | community data | community data licen[sc]e agreement
nlod-2.0 | norwegian | norwegian licen[sc]e for open government data
ogl-canada-2.0 | canada | open government licen[sc]e canada(?:{v}2 0)?
os-open-data | ordnance | ordnance survey open ?data licen[sc]e
c-uda-1.0 | computational use | computational use of data agreement
elastic-1.0 | elastic | elastic licen[sc]e agreement
redis-sal | redis | redis source available licen[sc]e(?: agreement)?
timescale | timescale | timescale licen[sc]e
cockroach | community | cockroachdb? community licen[sc]e
functional-source | functional | functional source licen[sc]e(?:{v}1 [01])?
proprietary | trade | (?:contains |is )?(?:confidential )?trade secrets? of
proprietary | redistribute | you may not (?:copy modify or )?redistribute
proprietary | personal | for (?:your )?personal (?:and )?non ?commercial use only
proprietary | content | subscribers? only content
reserved | diritti | tutti i diritti(?: sono)? riservati
reserved | direitos | todos os direitos reservados
reserved | rechten | alle rechten voorbehouden
reserved | rechte | alle rechte (?:liegen bei|beim)
reserved | derechos | derechos reservados
reserved | some | some rights reserved
warranty | damages | in no event shall the (?:authors?|copyright holders?) be liable for any (?:claim damages or other liability|direct indirect incidental special exemplary or consequential damages)
warranty | fitness | fitness for a particular purpose
"""

#: The GNU and Creative Commons families, whose rules follow one form.
_GNU = {"gpl": ("", "1 2 3"), "lgpl": ("(?:lesser|library) ", "2 2.1 3"), "agpl": ("affero ", "1 3")}
_CC = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s?", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
_CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keywords: frozenset
    regex: re.Pattern
    glued: tuple[frozenset, ...] = ()  # the keywords where a version follows one without a space


def _family_rules() -> list[tuple[str, str, str]]:
    """(label, keywords, regex) of the families, versions before the bare name."""
    out = []
    for name, (kind, versions) in _GNU.items():
        for v in versions.split():
            dots = v.replace(".", " ") + ("" if "." in v else "(?: 0)?")
            out += [
                (f"{name}-{v}", "general public", f"(?:gnu )?{kind}general public licen[sc]e{_V}{dots}{_LATER}"),
                (f"{name}-{v}", name, f"(?:gnu )?{name}{_V}{dots}{_LATER}"),
                (f"{name}-{v}", f"{name} spdx", f"spdx license identifier {name} {dots}(?: only| or later)?"),
                (f"{name}-{v}", f"{name}v{v[0]}", f"(?:gnu )?{name}v{dots}"),
                (f"{name}-{v}", "gnu licenses", f"gnu org licenses (?:old licenses )?{name} {dots}"),
            ]
        out += [(name, "general public", f"(?:gnu )?{kind}general public licen[sc]e"), (name, f"gnu {name}", f"gnu {name}"), (name, name, f"{name}")]
    for code, words in _CC.items():
        spaced = code.replace("-", " ")
        for v in _CC_VERSIONS.split():
            d = v.replace(".", " ")
            out += [
                (f"cc-{code}-{v}", "cc", f"cc {spaced} {d}"),
                (f"cc-{code}-{v}", "creative commons", f"creative commons {words}{_V}{d}(?: (?:international|unported|generic))?"),
                (f"cc-{code}-{v}", "creativecommons", f"creativecommons org licenses {spaced} {d}"),
            ]
        out += [(f"cc-{code}", "cc", f"cc {spaced}"), (f"cc-{code}", "creative commons", f"creative commons {words}")]
    return out


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, in order: families, then the list above; a priority is the place in that order."""
    listed = [tuple(x.strip() for x in line.split(" | ", 2)) for line in _RULES.strip().splitlines()]
    out = []
    for i, (label, keys, regex) in enumerate(_family_rules() + [(a, b, c.encode().decode("unicode_escape") if "\\u" in c else c) for a, b, c in listed]):
        body = regex.replace("{v}", _V).replace("{{", "{").replace("}}", "}")
        keywords = frozenset(k.encode() for k in keys.split())
        glued = [keywords - {k} | {k + d.encode()} for k in keywords for d in re.findall(re.escape(k.decode()) + r"(?:\(\?:)?" + re.escape(_V) + r"(\d)", body)]
        out.append(Rule(i, label, keywords, re.compile(rf"(?<= ){body}(?= )"), tuple(glued)))
    return tuple(out)


@lru_cache(maxsize=1)
def _gates() -> tuple[frozenset, dict[bytes, tuple[Rule, ...]]]:
    """One keyword of each rule's keywords, glued ones too, and the rules by it."""
    by: dict[bytes, list[Rule]] = {}
    for r in rules():
        for keys in (r.keywords, *r.glued):
            by.setdefault(max(keys, key=lambda k: (len(k), k)), []).append(r)
    return frozenset(by), {k: tuple(v) for k, v in by.items()}


@dataclass(frozen=True)
class Detection:
    label: str
    first: int  # word
    last: int
    priority: int


def resolve(found: list[Detection]) -> list[Detection]:
    """The detections that stay, in order of their places: one pass over them sorted.

    Inside another one's words: suppressed; on the same words: by priority. What is left rises in both ends,
    so only neighbours can cross: the one of worse priority goes, then the next neighbours are looked at.
    """
    kept: list[Detection] = []
    furthest = -1
    for d in sorted(found, key=lambda d: (d.first, -d.last, d.priority)):
        if d.last <= furthest:
            continue
        furthest = d.last
        while kept and kept[-1].last >= d.first and d.priority < kept[-1].priority:
            kept.pop()
        if not kept or kept[-1].last < d.first:
            kept.append(d)
    return kept


_BASE_WORDS = [(p.encode(), label) for p, label in BASE.items()]
_BASE_GATE = frozenset(p.split()[-1] for p, _ in _BASE_WORDS)


def scan(text: str | None) -> tuple[int, list[Detection], list[Detection]]:
    """Number of words, base places, and the method's own kept detections."""
    words = words_alnum(text)
    have = set(words)
    gates, by = _gates()
    hit = gates & have
    if not hit and not _BASE_GATE & have:
        return len(words), [], []
    joined = b" " + b" ".join(words) + b" "
    base: list[Detection] = []

    def places(lengths: list[int]) -> np.ndarray:
        """Where words of these lengths begin in the joined text."""
        spans = np.array(lengths, np.int64) + 1
        return 1 + np.cumsum(spans) - spans

    starts = places([len(w) for w in words])
    for phrase, label in _BASE_WORDS:
        at = joined.find(b" " + phrase + b" ")
        while at >= 0:
            first = int(np.searchsorted(starts, at + 1, side="right")) - 1
            base.append(Detection(label, first, first + phrase.count(b" "), -1))
            at = joined.find(b" " + phrase + b" ", at + 1)
    own: list[Detection] = []
    live = {r.priority: r for k in hit for r in by[k] if any(keys <= have for keys in (r.keywords, *r.glued))}.values()
    if live:
        chars = joined.decode("utf-8", "surrogatepass")
        if len(chars) != len(joined):
            starts = places([len(w.decode("utf-8", "surrogatepass")) for w in words])
        word_at = lambda i: int(np.searchsorted(starts, i, side="right")) - 1
        for r in live:
            own += [Detection(r.label, word_at(m.start()), word_at(m.end() - 1), r.priority) for m in r.regex.finditer(chars)]
    return len(words), base, resolve(own)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base and detections (arrays of label, first and last word) for every row of docs."""

    def run(batches):
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
        for c in rows_in_chunks(batches, "text"):
            got = [scan(t) for t in c["text"]]
            show = lambda ds: [{"label": d.label, "first": d.first, "last": d.last} for d in ds]
            yield pa.RecordBatch.from_arrays([pa.array(c["doc_id"], pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([show(g[1]) for g in got], kind), pa.array([show(g[2]) for g in got], kind)], ["doc_id", "n_words", "base", "detections"])

    kind = "array<struct<label:string,first:bigint,last:bigint>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), f"doc_id long, n_words long, base {kind}, detections {kind}")


def label_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    score is 0 without detections, else 1 - 2^-n for n places of base phrases and kept detections. A null
    or empty text has no words, no labels (empty strings) and null first and last word. Repeated rows get
    a row each; other columns are ignored.
    """
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    starts, base = F.transform("base", lambda d: d["first"]), F.transform("base", lambda d: d["label"])
    n = F.size("base") + F.size("detections")
    return detect(docs, id_col, text_col).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.concat(base, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        (1 - F.pow(F.lit(2.0), -n)).alias("score"),
    )
