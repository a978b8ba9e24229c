"""Personal information in free text, by weak supervision.

Labelers vote on candidate spans: the form of the span (a pattern), its surroundings (captions, greetings, cues for and
against, other personal data beside it), and a gazetteer of words learned from the collection itself, which votes for
words that often stand where only a name can and against words that seldom do. Candidates are wide: whatever has the
form, and whatever a greeting, title or cue points at. Expectation-maximisation over the vote patterns of all candidates
estimates how reliable each labeler is and how likely each pattern is right; a logistic span classifier over the votes
and the span's own features is trained on these soft labels and alone decides what is reported.
Votes and features are few-valued, so the patterns that reach the driver are bounded in number whatever the size of
the data. The counts of the gazetteer's most frequent words are sent to the workers; documents with words beyond them
get the counts of these words by a join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import cut

#: Words whose places are sent to the workers, the most frequent first; those of rarer words come by a join.
GAZETTEER_WORDS = 200_000
#: Share of a word's capitalised occurrences that must stand in a name's place.
NAME_SHARE = 0.12
LABELERS = ("form", "before", "pointed", "after", "gazetteer", "against", "beside")
FEATURES = ("words", "shape")

_TITLES = frozenset("prof dr mr mrs ms miss herr frau sr sra don doña mme mlle dear hi hello hey hallo hola bonjour".split())
_W = r"[^\W\d_]"
_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĻŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽ"
# --- e-mail ---
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punto|punkt|point)\s?[\])}]\s?|\s(?:dot|DOT|punto|punkt|point)\s)"
_AT = r"(?:\s?[\[({]\s?(?:at|AT|arroba|arobase)\s?[\])}]\s?|\s(?:at|AT|arroba|arobase)\s)"
_EMAIL = re.compile(r"(?<![\w.+%@/-])[\w+%-]+(?:\.[\w+%-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w(-])(?!:[\w/])")
_EMAIL_SPELT = re.compile(rf"(?<![\w.+%@/-])[\w+%-]+(?:\.[\w+%-]+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w-])")
_AT_WORD = re.compile(r"[\s\[({](?:at|AT|arroba|arobase)[\s\])}]")
# --- telephone ---
_EXT = r"(?:\s?(?:ext\.?|x|extension|Durchwahl|poste)\s?\d{1,5})?"
_PHONE = re.compile(
    rf"(?<![\w.+#/:-])(?:\+\d{{1,3}}[\s.-]?(?:\(0?\d{{0,4}}\)[\s.-]?)?\d{{1,4}}(?:[\s./-]?\d{{2,4}}){{1,5}}|\(\d{{3}}\)\s?\d{{3}}[-.\s]\d{{4}}|1[-. ]\d{{3}}[-. ]\d{{3}}[-. ]\d{{4}}|\d{{3}}([-.])\d{{3}}\1\d{{4}}|00\d{{2}}\d{{7,12}}|0\d{{2,4}}[/ ]\d{{3,8}}(?:-\d{{1,5}})?|[2-9]\d{{2}}[2-9]\d{{6}}){_EXT}(?![\w-]|\.\d)"
)
# --- identity numbers ---
_ID = re.compile(r"(?<![\w.+#/:-])(?:\d{8}[A-Z]|[XYZ]\d{7}[A-Z]|[A-Z]{1,2}\d{6,8}|\d{6}[-+]\d{4}|\d{3}-\d{2}-\d{4}|\d{2} \d{3} \d{3} \d{3}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{9}|\d{11}|\d{13})(?![\w-]|[.:/]\d)")
_STRONG_ID = re.compile(r"\d{8}[A-Z]|[XYZ]\d{7}[A-Z]|[A-Z]{2}\d{7}|\d{6}[-+]\d{4}|\d{3}-\d{2}-\d{4}|\d{2} \d{3} \d{3} \d{3}")
# --- street addresses ---
_UNIT = r"(?:Flat|Unit|Apt\.?|Apartment|Suite|Room|No\.)\s\d+\s?[A-Z]?"
_STREETS = r"(?:Street|Road|Close|Drive|Lane|Court|Way|Avenue|Boulevard|Place|Square|Terrace|Crescent|Gardens|Hill|Blvd|Ct|St|Rd|Ave|Dr|Ln|Pl|Sq)"
_ADDRESS = re.compile(
    rf"(?<![\w-])(?:(?:{_UNIT},\s)?\d{{1,5}}[a-z]?\s(?:[{_UP}][\w'’-]+\s){{1,3}}?{_STREETS}\b(?:,\s{_UNIT})?"
    rf"|(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|C/)\s(?:de\s(?:la\s|los\s)?|del\s)?[{_UP}]\w+(?:\s[{_UP}]\w+)?,?\s\d{{1,4}}[a-z]?(?:,\s\d{{1,2}}[ºª°](?:\s?(?:[A-Z]\b|izq\.?|dcha\.?))?)?"
    rf"|\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|boulevard|impasse|place|allée|chemin|quai|cours)\s(?:de\sla\s|des\s|du\s|de\sl['’]|de\s|d['’])?[{_UP}][\w'’-]+"
    rf"|[{_UP}]\w*(?:straße|strasse|weg|allee|gasse|platz|ring|damm|ufer|stieg)\s\d{{1,4}}\s?[a-z]?\b(?:,\s\d+\.\s(?:OG|Stock|Etage))?)"
)
# --- whatever looks remotely alike: candidates whose form speaks against them ---
_PHONE_WIDE = re.compile(r"(?<![\w.+#/:-])\+?\(?\d[\d ()./-]{5,17}\d(?![\w-]|\.\d)")
_ID_WIDE = re.compile(r"(?<![\w.+#/:-])(?:[A-Z]{0,3}\d{6,13}[A-Z]?|\d{2,6}[ -]\d{2,6}(?:[ -]\d{2,6})?)(?![\w-]|[.:/]\d)")
_ADDRESS_WIDE = re.compile(rf"(?<![\w.-])(?:\d{{1,5}}[a-z]?\s(?:[{_UP}][\w'’-]+\s){{0,2}}[{_UP}][\w'’-]+|[{_UP}]\w+\s(?:[{_UP}]\w+\s)?\d{{1,4}}[a-z]?\b(?!\.\d))")
# --- what stands before and after ---
_GREETING = re.compile(r"(?:^|[\s>\"'(-])(?:Dear|Hi|Hello|Hey|Hallo|Liebe[rs]?|Guten Tag|Hola|Querid[oa]|Estimad[oa]|Bonjour|Salut|Cher|Chère|Ciao)\s$")
_TITLE = re.compile(r"(?:^|[\s>\"'(|;-])(?:Prof|Dr|Mr|Mrs|Ms|Miss|Herr|Frau|Sr|Sra|Don|Doña|Mme|Mlle|M)\.?\s(?:Dr\.?\s)?$")
_NAME_BEFORE = re.compile(
    r"(?:\b(?:cc|thanks to|thank you|gracias a|merci à|danke an|author:?|owner:?|maintainer:?|assignee:?|reviewer:?|contact:?|from:|to:|name:|signed-off-by:|co-authored-by:|reviewed[ -]by:?|paired with|according to|stammt von|von frau|von herrn|student|alumn[oa]|l['’]élève|bitte|record shows|met|ask|tell|call|by)[\s\"']{1,3}|assignee=[\"']?|\"(?:owner|name|author|user|student)\":\s?\"|(?:--|regards,?|grüße,?|saludos,?|cordialement,?|cheers,?|best,?)\s*\n\s*|;\s?|VALUES\s?\(\d+,\s?'|(?:^|\n)(?:- )?\|\s)$",
    re.I,
)
_SIGNED = re.compile(r"(?:--|regards,?|grüße,?|saludos,?|cordialement,?|cheers,?|best,?)[ \t]*\n\s*$", re.I)
_NAME_AFTER = re.compile(r"(?:\s<|\s\(mailto:|\s(?:asked|wrote|said|reviewed|resubmitted|submitted|joined|replied|vive|anrufen|wohnt|habite|lives|and I|yesterday|for the patch|por la|on the second)\b|:\s(?:can|could|please|why|do)\b|\"?,\s\"?(?:mail|email|born)|',\s'|\s\||;|,?\n(?:\d|[A-Z]\w+\s\d|[A-Z]\w+(?:straße|weg|allee|gasse)|Calle|Flat|Unit))")
_GREETING_AFTER = re.compile(r"\s?[,:!\n]|\s[A-ZÀ-Þ(¿]|\s?$")
_PHONE_BEFORE = re.compile(r"(?:call|left|reach\w*|tel|phone|fax|mobile|number is|number:|text|ring|rückruf|unter|anrufen|teléfono|llam\w+|appel\w+|móvil|whatsapp|dial|handy|[|,;'(\[]|\n)[\s.:'\"(]*$", re.I)
_PHONE_AFTER = re.compile(r"\s?(?:\((?:mobile|cell|work|home|privat|mobil)|on the|before|when|if|,? ask|\||'|\)|still|oder|\n|$)", re.I)
_ID_BEFORE = re.compile(r"(?:ssn|social(?: security)?(?: number)?|passport(?: number| no\.?)?|pasaporte|ausweis\w*|personalausweis|reisepass\w*|tax(?: id| number)?|steuer\w*|national id|identity(?: number)?|id(?: card)?(?: number| no\.?)?|dni(?: del alumno| de la alumna)?|n[iu][fse]|nino|personnummer|cédula|numéro fiscal|carte d['’]identité|identi\w+)(?:\s(?:is|no\.?|nr\.?|number|ist|es|n[º°]))?[\s:#=\"']{0,3}$", re.I)
_ROW = re.compile(r"(?:^|\n|\b)row \d+:\s?$|[;|]\s?$", re.I)
_AGAINST = re.compile(r"(?:order|ticket|trace|trace id|commit|build|version|upgrade to|runner|port|line|lines|issue|seed|pr|revision|score|invoice|isbn|sha|hash|week|semana|woche|semaine|rows?|units|bytes|points|#)[\s#:=]{0,2}$", re.I)
_ADDRESS_BEFORE = re.compile(r"(?:address:?|moved to|badge to|goes to|map says|bounced,|paquete a|vive en|wohnhaft:?|lives at|home = \"?|home:?|adresse:?|dirección:?|;|\n)[\s\"']*$", re.I)
_TOKEN = re.compile(rf"{_W}+(?:['’-]{_W}+)*\.?")


def _name_parts(token: str) -> list[str]:
    token = token.rstrip(".").lower()
    if "-" in token or "'" in token or "’" in token:
        return [p for p in re.split(r"['’-]", token) if p]
    return [token] if token else []


#: What a greeting, a title or a cue for a name ends with, less its signs; fixed values.
_CUES = frozenset(
    "dear hi hello hey hallo liebe lieber liebes tag hola querido querida estimado estimada bonjour salut cher chère ciao prof dr mr mrs ms miss herr herrn frau sr sra don doña mme mlle m cc to you a à an author owner maintainer assignee reviewer contact from name signed-off-by co-authored-by reviewed-by by with von student alumno alumna l'élève l’élève bitte shows met ask tell call user regards grüße saludos cordialement cheers best".split()
)


def _may_be_cued(left: str) -> bool:
    """Whether what stands before a word can be a cue at all; cheaper than the patterns, and never narrower."""
    chunks = left.split()
    if not chunks:
        return False
    last = chunks[-1].lower().strip(".,:;\"'()[]{}|=<>-*#_/")
    return not last or last in _CUES or chunks[-1][-1] == ";" or "=" in chunks[-1] or '"' in chunks[-1]


# Lower-case words, but for parts of addresses, paths and identifiers, which say nothing about how a word is written.
_LOW = re.compile(rf"(?<![\w@+/.'’-])(?![{_UP}]){_W}{{2,}}(?:['’-]{_W}+)*(?![\w@+/]|[-.]\w)")


def word_places(text: str, counts: Counter) -> None:
    """Counts, for each word, its places: 0 in lower case, 1 capitalised, 2 where a name stands."""
    for word, n in Counter(_LOW.findall(text)).items():
        counts[word.lower(), 0] += n
    tokens = [m for m in _TOKEN.finditer(text) if m.group()[0].isupper()]
    for n, m in enumerate(tokens):
        token = m.group()
        for part in _name_parts(token):
            counts[part, 1] += 1
        if len(token) < 3:
            continue
        left = text[max(0, m.start() - 40) : m.start()]
        if not _may_be_cued(left):
            continue
        greeted = _GREETING.search(left)
        if not (greeted or _TITLE.search(left) or (not left.endswith(("; ", "\n")) and _NAME_BEFORE.search(left))):
            continue
        for part in _name_parts(token):
            counts[part, 2] += 1
        if greeted:
            continue
        for nxt in tokens[n + 1 : n + 3]:
            if text[m.end() : nxt.start()] not in (" ", ", ", "\n"):
                break
            if len(nxt.group()) > 2:
                for part in _name_parts(nxt.group()):
                    counts[part, 2] += 1
                break
            m = nxt


def vote_of(low: int, cap: int, held: int) -> int:
    """Whether a word with these places is a name (1), none (-1), or met too seldom to tell (0); shares are smoothed by
    half an occurrence, so the same evidence counts alike in a collection of any size."""
    if low > 0.1 * cap or held + 0.5 < NAME_SHARE * cap:
        return -1
    return 1 if held > 0 and held >= NAME_SHARE * cap else 0


def places_of(documents: DataFrame, text: str) -> DataFrame:
    """``(word, low, cap, held)``: the places of every word that is ever capitalised, over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                word_places(t, counts)
            if len(counts) > 500_000:
                yield _places(counts)
                counts = Counter()
        if counts:
            yield _places(counts)

    texts = documents.select(F.col(text).alias("text")).where("text is not null")
    places = texts.mapInPandas(count, "word string, low bigint, cap bigint, held bigint").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("low", "cap", "held")))
    return cut(places.where("cap > 0"))


def _places(counts: Counter) -> pd.DataFrame:
    by: dict[str, list[int]] = {}
    for (word, place), n in counts.items():
        by.setdefault(word, [0, 0, 0])[place] += n
    return pd.DataFrame([(w, *v) for w, v in by.items()], columns=["word", "low", "cap", "held"])


#: (type, start, end), the votes of LABELERS but for the last, and FEATURES
Candidate = tuple[str, int, int, int, int, int, int, int, int, int, int]


def _names(text: str, votes: dict[str, int], missing: set[str] | None) -> Iterator[Candidate]:
    """Runs of capitalised words: those that a greeting, title or cue points at, and those of several words. Words
    without a vote are added to ``missing``."""
    tokens = [m for m in _TOKEN.finditer(text) if m.group()[0].isupper()]

    def vote(m: re.Match) -> int:
        parts = _name_parts(m.group())
        if not parts or len(parts[0]) < 2:
            return -1
        got = []
        for p in parts:
            v = -1 if p in _TITLES else votes.get(p)
            if v is None:
                v = 0
                if missing is not None:
                    missing.add(p)
            got.append(v)
        return min(got)

    def is_initial(m: re.Match) -> bool:
        return len(m.group()) == 2 and m.group()[1] == "."

    def may_be(m: re.Match) -> bool:
        return vote(m) >= 0 and len(_name_parts(m.group())[0]) > 2

    n = 0
    while n < len(tokens):
        m = tokens[n]
        lone = is_initial(m)
        left = text[max(0, m.start() - 40) : m.start()]
        greeted = titled = cue = False
        if _may_be_cued(left):
            greeted, titled = bool(_GREETING.search(left)), bool(_TITLE.search(left))
            cue = greeted or titled or bool(_NAME_BEFORE.search(left))
        plain = not lone and not may_be(m)  # an ordinary word: a candidate only where something points at it, or in a run
        if plain and not cue and not (n + 1 < len(tokens) and text[m.end() : tokens[n + 1].start()] == " " and len(m.group()) > 2 and len(tokens[n + 1].group()) > 2 and not may_be(tokens[n + 1])):
            n += 1
            continue
        last, words, initials, reverse = n, int(not lone), int(lone), False
        for k in range(n + 1, min(n + 4, len(tokens))):
            gap, nxt = text[tokens[k - 1].end() : tokens[k].start()], tokens[k]
            stopped = tokens[k - 1].group().endswith(".") and not is_initial(tokens[k - 1])
            joined = may_be(nxt) if not plain or cue else not may_be(nxt) and len(nxt.group()) > 2
            if stopped or not (gap in (" ", "\n", "  ", " \n") or (gap in (", ", ",\n") and not reverse and not greeted and not plain and words == 1 and initials == 0 and joined)):
                break
            if joined and words < 3 and not (gap[0] == "\n" and not (vote(nxt) > 0 or vote(tokens[k - 1]) > 0)):
                words += 1
            elif is_initial(nxt) and initials == 0 and gap == " " and not plain:
                initials += 1
            else:
                break
            reverse = reverse or gap[0] == ","
            last = k
        end = tokens[last].end()
        if tokens[last].group().endswith(".") and not is_initial(tokens[last]):
            end -= 1
        if lone and words == 0:
            n += 1
            continue
        # an initial that closes a sentence belongs to the name only if the name is otherwise one word
        if is_initial(tokens[last]) and words > 1:
            last -= 1
            end = tokens[last].end()
        full = words + initials > 1
        if not full and not cue:
            n = last + 1
            continue  # one word that nothing points at has neither the form nor the place of a name
        right = text[end : end + 30]
        told = [vote(tokens[k]) for k in range(n, last + 1) if not is_initial(tokens[k])]
        after = bool(_NAME_AFTER.match(right)) or (greeted and bool(_GREETING_AFTER.match(right)))
        yield "person", m.start(), end, 1 if initials or reverse or (greeted and not full) else 0 if full else -1, int(cue and (full or greeted or titled)), int(greeted or titled or (full and bool(_SIGNED.search(left)))), int(after), -1 if min(told) < 0 else max(told), -int(not full and not (greeted or titled)), min(words, 3) * 2 + (initials > 0), int(greeted) + 2 * int(titled)
        n = last + 1


def _candidates(text: str, votes: dict[str, int], missing: set[str] | None = None) -> Iterator[tuple[bool, Candidate]]:
    """Candidates and whether they come from the wide patterns."""
    for spelt, pattern in enumerate((_EMAIL, _EMAIL_SPELT)):
        for m in pattern.finditer(text) if (_AT_WORD.search(text) if spelt else "@" in text) else ():
            left, after = text[max(0, m.start() - 12) : m.start()], text[m.end() : m.end() + 2]
            remote = left.endswith(("://", "ssh ", "clone ", "remote ", "origin "))
            path = after[:1] in (":", "/") and after[1:].isalnum()
            goes_on = after[:1] in ("+", "@", "%") or after[:1] == "." and after[1:].isalnum()  # what was found is a part of an address
            service = m.group().lower().startswith(("git@", "hg@", "svn@"))
            yield False, ("email", m.start(), m.end(), -1 if goes_on or service else 1, -1 if remote else int(bool(re.search(r"[<(:|\"\s=]$", left)) or not left), 0, -1 if path or goes_on else 1, 0, -int(remote or path), spelt, int(any(c.isdigit() for c in m.group())))
    for wide, pattern in enumerate((_PHONE, _PHONE_WIDE)):
        for m in pattern.finditer(text):
            left, right, v = text[max(0, m.start() - 30) : m.start()], text[m.end() : m.end() + 20], m.group()
            digits = sum(c.isdigit() for c in v)
            if digits < 7 or digits > 20:
                continue
            bare = v.isdigit() and v[0] != "0"
            plan = not wide and (v[0] in "+(" or v[:2] in ("00", "1-") or bool(re.match(r"0\d+/", v)))  # a numbering plan's prefix
            grouped = bool(re.match(r"1?[-. ]?\d{3}[-.]\d{3}[-.]\d{4}", v))
            yield bool(wide), ("phone", m.start(), m.end(), -1 if wide or bare else 1 if plan or grouped else 0, int(bool(_PHONE_BEFORE.search(left))), 0, int(bool(_PHONE_AFTER.match(right))), 1 if plan else -1 if wide else 0, -int(bool(_AGAINST.search(left)) or bool(_ID_BEFORE.search(left))), min(digits // 3, 5), int(bare) + 2 * wide)
    for wide, pattern in enumerate((_ID, _ID_WIDE)):
        for m in pattern.finditer(text):
            left, right, v = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 4], m.group()
            caption = bool(_ID_BEFORE.search(left)) and not re.search(r"(?:trace|fixture|order|event|doc)\s*id\W*$", left, re.I)
            row = bool(_ROW.search(left)) and right[:1] in (";", "|")
            form = -1 if wide else 1 if _STRONG_ID.fullmatch(v) else 0
            yield bool(wide), ("id_number", m.start(), m.end(), form, 1 if caption or row else -int(form < 1), 0, int(row or right[:1] in (",", ".", " ", "\n", "")), 0, -int(bool(_AGAINST.search(left))), int(v[0].isalpha()) + 2 * int(v[-1].isalpha()), int(v.isdigit()) + 2 * int("-" in v or " " in v) + 4 * wide)
    for wide, pattern in enumerate((_ADDRESS, _ADDRESS_WIDE)):
        for m in pattern.finditer(text):
            left = text[max(0, m.start() - 30) : m.start()]
            caption = _ADDRESS_BEFORE.search(left)
            yield bool(wide), ("address", m.start(), m.end(), -1 if wide else 1, int(bool(caption) and caption.group().strip() != ""), 0, int(text[m.end() : m.end() + 1] in (",", ".", ";", "\n", "", '"', "|")), -1 if wide else 1, -int(bool(_AGAINST.search(left))), int(m.group()[0].isdigit()), int("," in m.group()))
    for c in _names(text, votes, missing):
        yield False, c


def candidates_in(text: str, votes: dict[str, int], missing: set[str] | None = None) -> list[tuple]:
    """``(type, start, end, votes of LABELERS, FEATURES)`` of the candidate spans of a text."""
    # Where spans meet, the better form stays, then the earlier and longer span; a name never eats another type.
    rank = {"email": 0, "address": 1, "phone": 2, "id_number": 3, "person": 4}
    chosen: list[Candidate] = []
    taken: list[tuple[int, int]] = []
    for _, c in sorted(_candidates(text, votes, missing), key=lambda x: (x[0], x[1][3] < 0 or x[1][8] < 0, rank[x[1][0]], x[1][1], -x[1][2])):
        if all(c[2] <= s or c[1] >= e for s, e in taken):
            chosen.append(c)
            taken.append((c[1], c[2]))
    chosen.sort(key=lambda c: c[1])
    out = []
    for n, c in enumerate(chosen):
        # Rows, signatures and headers hold several kinds of personal data side by side.
        beside = False
        for other, gap in ((chosen[n - 1], text[chosen[n - 1][2] : c[1]]) if n else (None, ""), (chosen[n + 1], text[c[2] : chosen[n + 1][1]]) if n + 1 < len(chosen) else (None, "")):
            if other and other[0] != c[0] and other[3] >= 0 and len(gap) <= 6 and re.fullmatch(r"[\s;|<(,'\"]+", gap) and gap != " ":
                beside = True
        out.append((*c[:9], int(beside), *c[9:]))
    return out


#: How far EM may move from the assumption that a vote is right more often than not, as a share of a side's candidates.
ANCHOR = 0.05


def reliabilities(patterns: np.ndarray, weights: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) with their counts.

    Returns the posterior of each pattern being right and each labeler's P(vote | right), P(vote | wrong).
    """
    post = 1 / (1 + np.exp(-1.2 * patterns.sum(1)))
    # Anchors: before any data, a labeler's vote for a span is likelier if the span is right, and one against it if not.
    anchor = np.array([[0.1, 0.3, 0.6], [0.6, 0.3, 0.1]])[:, None, :]
    for _ in range(rounds):
        share = [post * weights, (1 - post) * weights]
        table = np.zeros((2, patterns.shape[1], 3))
        for side in (0, 1):
            for v in (-1, 0, 1):
                table[side, :, v + 1] = ((patterns == v) * share[side][:, None]).sum(0)
            table[side] += anchor[side] * (ANCHOR * share[side].sum() + 1)
        table /= table.sum(2, keepdims=True)
        prior = np.clip(share[0].sum() / weights.sum(), 0.01, 0.99)
        logs = [np.log(p) + np.log(np.take_along_axis(table[side].T, patterns + 1, 0)).sum(1) for side, p in ((0, prior), (1, 1 - prior))]
        post = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
    return post, table


def _encoded(patterns: np.ndarray, features: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """One-hot votes, pairs of votes and features, and a constant."""
    votes = np.concatenate([patterns == -1, patterns == 1], axis=1).astype(float)
    pairs = np.stack([patterns[:, i] * patterns[:, j] for i in range(patterns.shape[1]) for j in range(i)], axis=1)
    own = [(features[:, [n]] == values[None]).astype(float) for n, values in enumerate(known)]
    return np.concatenate([votes, pairs, *own, np.ones((len(patterns), 1))], axis=1)


def train_classifier(x: np.ndarray, weights: np.ndarray, soft: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic classifier fitted to soft labels by Newton steps with a ridge."""
    w, n = np.zeros(x.shape[1]), weights / weights.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ ((p - soft) * n) + 1e-4 * w
        bend = (x.T * (p * (1 - p) * n)) @ x + 1e-4 * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return w


def decide(patterns: np.ndarray, features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probability of each pattern of votes and features: the span classifier's, trained on EM's soft labels."""
    post, _ = reliabilities(patterns, weights)
    x = _encoded(patterns, features, [np.unique(features[:, n]) for n in range(features.shape[1])])
    return 1 / (1 + np.exp(-np.clip(x @ train_classifier(x, weights, post), -30, 30)))


def personal_spans(documents: DataFrame, doc_id: str, text: str, *, words: int = GAZETTEER_WORDS) -> DataFrame:
    """``(doc_id, pii_type, start, length, pii_text, probability)`` of every accepted span.

    Positions count code points from 0. Null ids and texts are left out; an empty text has no spans; repeated rows give
    repeated equal rows; an empty table gives no rows. ``words`` bounds what is broadcast, not what is known.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    places = places_of(rows, "text")
    top = {r["word"]: vote_of(r["low"], r["cap"], r["held"]) for r in places.orderBy(F.desc("cap"), "word").limit(words).collect()}
    shared = spark.sparkContext.broadcast(top)  # at most ``words`` entries
    names = [*LABELERS, *FEATURES]
    shape = "doc_id bigint, pii_type string, start int, length int, pii_text string, " + ", ".join(f"{x} int" for x in names)

    def rows_of(i: int, t: str, votes: dict[str, int], missing: set[str] | None = None) -> list[tuple]:
        return [(i, c[0], c[1], c[2] - c[1], t[c[1] : c[2]], *c[3:]) for c in candidates_in(t, votes, missing)]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Candidates; a document with words beyond the broadcast gives only these words."""
        for pdf in batches:
            out = []
            for i, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                missing: set[str] = set()
                got = rows_of(i, t, shared.value, missing)
                out.extend([(*r, None) for r in got] if not missing else [(i, "open", 0, 0, None, *[0] * len(names), sorted(missing))])
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "pii_type", "start", "length", "pii_text", *names, "rare"])

    def search_open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t, own in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["own"].tolist(), strict=True):
                out.extend(rows_of(i, t, {**shared.value, **{x["word"]: vote_of(x["low"], x["cap"], x["held"]) for x in own}}))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "pii_type", "start", "length", "pii_text", *names])

    first = cut(rows.mapInPandas(search, shape + ", rare array<string>"))
    found = first.where("pii_type <> 'open'").drop("rare")
    rare = first.where("pii_type = 'open'").select("doc_id", F.explode("rare").alias("word")).distinct()
    if places.limit(words + 1).count() > words:
        own = rare.join(places, "word").groupBy("doc_id").agg(F.collect_list(F.struct("word", "low", "cap", "held")).alias("own"))
        found = found.unionByName(cut(rows.join(own, "doc_id").mapInPandas(search_open, shape)))
    counted = found.groupBy("pii_type", *names).count().collect()  # types x 3^7 votes x values of the features, at most
    judged = []
    for kind in sorted({r["pii_type"] for r in counted}):
        own = sorted((r for r in counted if r["pii_type"] == kind), key=lambda r: tuple(r[x] for x in names))
        patterns, features = np.array([[r[x] for x in LABELERS] for r in own]), np.array([[r[x] for x in FEATURES] for r in own])
        for r, p in zip(own, decide(patterns, features, np.array([float(r["count"]) for r in own])), strict=True):
            judged.append((kind, *(r[x] for x in names), float(p)))
    table = spark.createDataFrame(judged, "pii_type string, " + ", ".join(f"{x} int" for x in names) + ", probability double")
    return found.join(F.broadcast(table.where("probability >= 0.5")), ["pii_type", *names]).select("doc_id", "pii_type", "start", "length", "pii_text", "probability")


def masked(documents: DataFrame, doc_id: str, text: str, spans: DataFrame) -> DataFrame:
    """``(doc_id, text)``: every document with its spans replaced by typed placeholders such as ``[EMAIL]``."""
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null").dropDuplicates(["doc_id"])
    marks = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "length", "pii_type"))).alias("marks"))

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, own in zip(pdf["text"], pdf["marks"], strict=True):
                if t is not None and own is not None:
                    parts, at = [], 0
                    for x in own:
                        if x["start"] >= at:
                            parts += [t[at : x["start"]], f"[{x['pii_type'].upper()}]"]
                            at = x["start"] + x["length"]
                    t = "".join([*parts, t[at:]])
                out.append(t)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": out})

    return rows.join(marks, "doc_id", "left").mapInPandas(replace, "doc_id bigint, text string")
