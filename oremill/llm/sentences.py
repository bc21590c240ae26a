"""Sentences of texts in many languages and scripts, as ranges of code points."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of the languages served ---------------------------------------------------------------------------

#: Points behind these never end a sentence: titles, and words that something must follow.
NEVER = frozenset(
    "dr prof mr mrs ms messrs st mt rev hon gen col capt lt sgt gov sen rep pres approx incl excl max min vs ed eds e.g i.e a.k.a viz resp cf ca "
    "hr fr hrn frl dipl ing geb gegr bzw vgl z.b d.h u.a z.t evtl ggf inkl exkl zzgl sog "
    "sr sra srta srtas sres sras ud uds vd vds d.ª dña aprox av avda ej p.ej "
    "m mm mme mmes mlle mlles mgr env av.j.-c p.ex "
    "г-н г-жа гр тов ок ул пр пер просп наб корп стр акад проф др.-инж им напр см "
    "κ κα κος κκ δρ καθ περ π.χ βλ δηλ οδ "
    "डॉ श्री श्रीमती प्रो सुश्री कु रु د أ م ا ب".split()
)
#: Points behind these don't end a sentence before a number; otherwise they are as MAYBE.
BEFORE_NUMBER = frozenset(
    "no nos nr nrn fig figs vol vols p pp ch chap sec art par pág págs pag núm num cap tel abb bd kap s jan feb mar apr jun jul aug sep sept oct nov dec "
    "д корп кв стр рис гл т № n° nº αρ σελ εικ κεφ".split()
)
#: Points behind these end a sentence only where a new one follows.
MAYBE = frozenset("etc a.m p.m inc co corp ltd llc jr bros usw u.s.w u.v.m ff gmbh руб коп тыс млн млрд т.д т.п др π.μ μ.μ κ.λπ κλπ κ.ά s.a c.a u.s u.k u.s.a kg km cm min std h lb oz ft hr hrs".split())
#: Of MAYBE, those that a sentence often goes on after even where case tells nothing.
NAMES = frozenset("inc co corp ltd llc jr bros gmbh s.a u.s u.k u.s.a".split())
#: Words that carry a sentence on, after an abbreviation or a quotation, where case tells nothing.
ONWARD = frozenset(
    "and or but with sharp on at in to from until till of for daily every each when while so as plus by than which who is are was were "
    "y e o u con según de del hasta en a pero et ou avec puis de à selon und oder mit dann bis nach aber в и на с за или но до по και ή με κάθε από αλλά".split()
)
#: Verbs that attribute a quotation, where case tells nothing.
SAYING = frozenset(
    "said says say asked asks told shouted cried whispered answered replied called wrote added gritó dijo exclamó preguntó respondió rief sagte fragte schrie meinte "
    "crié dit demandé répondu a сказал сказала спросил спросила крикнул крикнула ответил φώναξε είπε ρώτησε".split()
)
#: German words before an ordinal number.
ORDINAL_BEFORE = frozenset("am im vom zum beim bis ab seit der die das den dem des ins dritten jeden".split())
#: Endings of file and host names.
FILE_ENDINGS = frozenset("pdf txt csv doc docx xls xlsx html htm xml json jpg jpeg png gif zip gz mp3 mp4 py js exe com org net edu gov io de uk fr es ru".split())

#: Closing marks.
MARKS = ".!?…。．！？｡؟।॥۔‼⁇⁈⁉"
#: Opening marks and what closes them.
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "《": "》", "〈": "〉", "「": "」", "『": "』", "“": "”", "„": "“”", "«": "»", "‘": "’", "‹": "›", "‚": "‘’", '"': '"'}
BRACKETS = "([{（［【《〈"
CLOSERS = "".join(dict.fromkeys("".join(PAIRS.values()) + "'＂"))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
BULLETS = "-*•◦▪‣·"

_LINE = re.compile(r"[^\r\n\x0b\x0c\x85\u2028\u2029]*(?:\r\n|[\r\n\x0b\x0c\x85\u2028\u2029]|\Z)")
_ITEM = re.compile(rf"[^\S\r\n]*(?:([{re.escape(BULLETS)}])|(\d{{1,3}})[.)])[^\S\r\n]+\S")
_CLUSTER = re.compile(rf"[{re.escape(MARKS)};\u037e][{re.escape(MARKS)};\u037e{INVISIBLE}]*|(?<=[\u0e01-\u0e5b])\s+(?=\S)")
_EMOJI = re.compile("\\s*(?:[\U0001f000-\U0001faff\u2600-\u27bf\u2b00-\u2bff\u2300-\u23ff\ufe0f\u20e3]|\u200d(?=[\U0001f000-\U0001faff\u2600-\u27bf]))+")
_DROP = {ord(c): None for c in INVISIBLE}

#: Costs and gains of the spans. SPLIT is what a span pays for a quotation or bracket that it leaves open, or that was opened before it.
SURE, LIKELY, EMPTY, LONG, LONG_FROM, SPLIT = 4.0, 2.0, -9.0, 0.002, 600, 1000.0
#: Longer than any word of the lists above. Of a longer run without white space only the ends, and which characters are between, can matter.
WORD = 64


def _plain(word: str) -> str:
    return unicodedata.normalize("NFC", word.translate(_DROP)).lower()


def _blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Parts of a text that a sentence can't cross: (start, end, whether it is a list item). Blank lines and list items bound them."""
    lines = [(m.start(), m.end()) for m in _LINE.finditer(text) if m.end() > m.start()]
    marks = [_ITEM.match(text, a, b) for a, b in lines]
    numbers = [int(m.group(2)) if m and m.group(2) else None for m in marks]
    start, item, last = None, False, None
    for i, (a, b) in enumerate(lines):
        blank = not text[a:b].strip()
        new = False
        if not blank and marks[i]:
            n = numbers[i]
            if n is None:
                new = True
            else:
                follows = i + 1 < len(lines) and numbers[i + 1] == n + 1
                new = start is None or follows or (item and last == n - 1) or text[start:a].rstrip().endswith((":", "："))
        if blank or new:
            if start is not None:
                yield start, a, item
            start, item, last = (a, True, numbers[i]) if new else (None, False, None)
        elif start is None:
            start, item, last = a, False, None
    if start is not None:
        yield start, len(text), item


def _matched(s: str) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Closing place -> opening place of the quotations and brackets of a block that are balanced; and the outermost of them. They may stand in one
    another to any depth."""
    stack: list[tuple[int, str]] = []
    #: For each closing mark, where in the stack those stand that it closes. Places that are gone are dropped when they are met.
    waiting: dict[str, list[tuple[int, int]]] = {}
    pairs: dict[int, int] = {}
    n = len(s)

    def latest(c: str) -> int:
        at = waiting.get(c, [])
        while at and (at[-1][0] >= len(stack) or stack[at[-1][0]][0] != at[-1][1]):
            at.pop()
        return at[-1][0] if at else -1

    def push(i: int, closers: str) -> None:
        for c in closers:
            waiting.setdefault(c, []).append((len(stack), i))
        stack.append((i, closers))

    for m in _MARKED.finditer(s):
        i, c = m.start(), m.group()
        before, after = s[i - 1] if i else " ", s[i + 1] if i + 1 < n else " "
        closes = latest(c)
        if c == '"':
            opening = (before.isspace() or before in BRACKETS or before in MARKS and not closes >= 0) and not after.isspace()
            if closes >= 0 and not (opening and before.isspace()):
                pairs[i] = stack[closes][0]
                del stack[closes:]
            elif opening:
                push(i, '"')
            continue
        if c == "’" and closes >= 0 and before.isalpha() and after.isalpha():
            continue
        if closes >= 0:
            pairs[i] = stack[closes][0]
            del stack[closes:]
        elif c in PAIRS:
            push(i, PAIRS[c])
    outer: list[tuple[int, int]] = []
    for close, start in sorted(pairs.items(), key=lambda x: (x[1], -x[0])):
        if not outer or start > outer[-1][1]:
            outer.append((start, close))
    return pairs, outer


_QUOTABLE = frozenset("".join(PAIRS) + "".join(PAIRS.values()))
_MARKED = re.compile(f"[{re.escape(''.join(sorted(_QUOTABLE)))}]")


class _Block:
    """Candidate ends of one block and what they score."""

    def __init__(self, s: str) -> None:
        self.s = s
        self.pairs, outer = _matched(s) if not _QUOTABLE.isdisjoint(s) else ({}, [])
        self.outer = outer
        self.opens = set(self.pairs.values())
        upper = sum(c.isupper() for c in s)
        lower = sum(c.islower() for c in s)
        #: Whether capitals tell anything here.
        self.cased = bool(upper and lower and lower >= upper * 0.6)
        self.ends: list[int] = []
        #: For each end, its score, or where the quotation that it closes opens and its scores at the start of a sentence and inside.
        self.scores: list[float | tuple[int, float, float]] = []
        #: The run of other than white space around the place looked at, and the one before it; places only grow.
        self.run, self.before, self.gaps = (0, 0), (0, 0), _SPACES.finditer(s)
        self.run_end = -1
        self.between: tuple[int, int, set[str]] = (-1, 0, set())
        self.last_odd = (-1, -1)
        self.punctuation = (0, 0)
        self._find()
        #: For each end, whether it lies in a quotation or bracket.
        self.split = [bool(outer) and self._inside(e) is not None for e in self.ends]

    def _move(self, i: int) -> None:
        """Let `run` be the run without white space that place i is in or behind."""
        while self.run_end < i:
            if self.run_end >= 0:
                self.before = self.run
            gap = next(self.gaps, None)
            start = self.gap_end if self.run_end >= 0 else 0
            if gap is None:
                self.run, self.run_end = (start, len(self.s)), len(self.s)
                break
            self.run, self.run_end, self.gap_end = (start, gap.start()), gap.end() - 1, gap.end()

    def _token(self, i: int) -> str:
        """The run in front of place i, plain. Of one longer than 4 * WORD its ends and, between them, each character once."""
        self._move(i)
        start, s = self.run[0], self.s
        if i - start <= 4 * WORD:
            return _plain(s[start:i])
        of, upto, seen = self.between
        if of != start:
            upto, seen = start + 2 * WORD, set()
        seen.update(s[upto : i - 2 * WORD])
        self.between = (start, max(upto, i - 2 * WORD), seen)
        return _plain(s[start : start + 2 * WORD] + "".join(sorted(seen)) + s[i - 2 * WORD : i])

    def _odd_behind(self, end: int) -> bool:
        """Whether the rest of the run behind `end` has a digit or a sign of addresses and files."""
        self._move(end)
        if self.last_odd[0] != self.run[0]:
            self.last_odd = (self.run[0], max((m.start() for m in _ODD.finditer(self.s, *self.run)), default=-1))
        return self.last_odd[1] >= end

    def _inside(self, i: int) -> tuple[int, int] | None:
        a, b = 0, len(self.outer)
        while a < b:
            m = (a + b) // 2
            if self.outer[m][1] < i:
                a = m + 1
            else:
                b = m
        return self.outer[a] if a < len(self.outer) and self.outer[a][0] < i <= self.outer[a][1] else None

    def _find(self) -> None:
        s, n = self.s, len(self.s)
        at = 0
        while m := _CLUSTER.search(s, at):
            i, j = m.start(), m.end()
            at = j
            mark = m.group()
            if mark.isspace():
                # Thai: a space without a digit next to it.
                if not s[j].isdigit() and not s[i - 1].isdigit() and s[j] not in CLOSERS and s[j] not in MARKS:
                    self._put(j, SURE)
                continue
            bare = mark.translate(_DROP)
            if bare[0] in ";\u037e":
                if not (i and "GREEK" in unicodedata.name(s[i - 1], "")):
                    at = i + 1
                    continue
            elif ";" in bare:
                j = at = i + mark.index(";")
                bare = bare[: bare.index(";")]
            outside = self._inside(i)
            end = j
            # Quotes, brackets and invisible characters right behind the mark.
            while end < n:
                k = end
                while k < n and s[k] in "\u00a0\u202f":
                    k += 1
                if k < n and (k in self.pairs or s[k] in CLOSERS and not (s[k] in PAIRS and self._opens(k)) and k == end) and not (s[k] == "'" and k + 1 < n and s[k + 1].isalpha()):
                    end = k + 1
                elif s[end] in INVISIBLE:
                    end += 1
                else:
                    break
            closed = outside and outside[1] < end
            at = max(at, end)
            if closed:
                self._quotation(i, bare, outside, end)
            else:
                score = self._mark(i, bare, j if end == j else end)
                if score > -100:
                    self._put(end, score)

    def _opens(self, k: int) -> bool:
        return k in self.opens or s_opens(self.s, k)

    def _put(self, end: int, score: float | tuple[int, float, float]) -> None:
        if m := _EMOJI.match(self.s, end):
            end = m.end()
        rest = end
        while rest < len(self.s) and self.s[rest].isspace():
            rest += 1
        if rest < len(self.s) and (not self.ends or self.ends[-1] < end):
            self.ends.append(end)
            self.scores.append(score)

    def _after(self, end: int) -> tuple[bool, str, str]:
        """Whether space follows, the next character, and the next word."""
        s, k = self.s, end
        while k < len(s) and (s[k].isspace() or s[k] in INVISIBLE):
            k += 1
        word = _WORD.match(s, k, k + 2 * WORD)
        if s[k : k + 1] in PAIRS and not self.punctuation[0] <= k < self.punctuation[1]:
            self.punctuation = (k, _INNER.match(s, k).end())
        self.first = s[self.punctuation[1] : self.punctuation[1] + 1]
        return k > end and any(c.isspace() for c in s[end:k]), s[k] if k < len(s) else "", _plain(word.group()) if word else ""

    def _new(self, char: str, word: str, usual: bool) -> float:
        """Whether a new sentence seems to start with the word, where it could also go on. `usual`: what holds if nothing tells."""
        if char in "¿¡":
            return LIKELY
        if char in PAIRS:
            # What stands in the quotation or bracket tells.
            char = self.first
        if self.cased and (char.isupper() or char.islower()):
            return SURE if char.isupper() else -SURE
        if word in ONWARD:
            return -SURE
        return LIKELY if usual and (char.isalpha() or char.isdigit()) else -LIKELY

    def _mark(self, i: int, bare: str, end: int) -> float:
        """Score of an end at a mark outside quotations; -inf if there can't be one."""
        s = self.s
        spaced, char, word = self._after(end)
        never = float("-inf")
        if not char:
            return never
        if bare[0] == "…" or bare.startswith("..") and set(bare) <= set(".…"):
            if set(bare) <= set(".…"):
                if not spaced or char in ",;:-–—)":
                    return never
                if self.cased and char.isupper():
                    return SURE
                return LIKELY if char in "¿¡" else never
            return SURE
        if bare != ".":
            return never if char in ",;:" and not spaced else SURE
        if char in ",;:)/%-–—=&" and not spaced or char in ",;:)":
            return never
        token = self._token(i)
        # Up to the white space in front of the token; the last word of it is self.before.
        before = s[max(self.before[0], self.before[1] - WORD) : self.before[1]] if self.run[0] else ""
        if not spaced:
            return self._unspaced(i, end, token, char, word)
        if token and token[-1].isdigit():
            digits = token.lstrip("(±$€£#")
            if digits.isdigit() and len(digits) <= 2:
                if _plain(before) in ORDINAL_BEFORE and char.isalpha():
                    return -SURE
            if char.isdigit() and not self.cased:
                return LIKELY
            return SURE
        return self._abbreviation(token, before, char, word)

    def _abbreviation(self, token: str, before: str, char: str, word: str) -> float:
        core = token.lstrip("(\"'“‘«„¿¡[").rstrip("\"'”’»")
        if core in MAYBE and not (core in NEVER or core in BEFORE_NUMBER) or (core in MAYBE and self._unit(before)):
            return self._new(char, word, usual=core not in NAMES)
        if core in BEFORE_NUMBER:
            if char.isdigit():
                return -SURE
            if len(core) > 1:
                return self._new(char, word, usual=True)
        if len(core) == 1 and core.isalpha():
            previous = _plain(before[-3:])
            if (core in "m" and previous.endswith(("p.", "a."))) or (core in "дп" and previous.endswith("т.")) or (core == "μ" and previous.endswith(("π.", "μ."))):
                return self._new(char, word, usual=True)
            if self._unit(before):
                return self._new(char, word, usual=True)
            return -SURE
        if core in NEVER:
            return -SURE
        if core.endswith("str") and len(core) > 3:
            return self._new(char, word, usual=False)
        parts = core.split(".")
        if len(parts) > 1 and all(len(p) == 1 and p.isalpha() for p in parts):
            # Initials and the like.
            return -SURE if not self.cased or char.isupper() and len(parts) > 1 and word not in _STARTS else self._new(char, word, usual=False)
        return SURE

    @staticmethod
    def _unit(before: str) -> bool:
        return bool(before) and before[-1].isdigit()

    def _unspaced(self, i: int, end: int, token: str, char: str, word: str) -> float:
        """A point with no space behind it."""
        never = float("-inf")
        if end > i + 1 and self.s[i + 1] not in INVISIBLE:
            return SURE if not char.islower() else never  # a closing quote or bracket without its opening one stands between
        if char in "¿¡" or char in PAIRS and char not in "([{" and char != '"':
            return never if self._abbreviation(token, "", char, "") < 0 else SURE
        if not char.isalpha():
            return never
        raw = self.s[end : end + 2]
        if "." in token or "@" in token or "/" in token or "_" in token or ":" in token:
            if not (token in MAYBE and char.isupper()):
                return never
        if token and token[-1].isdigit():
            return SURE if token.lstrip("(±$€£#").replace(",", "").isdigit() and char.isupper() and len(word) > 1 and self.cased else never
        if token in NEVER or len(token) < 2 or token in BEFORE_NUMBER:
            return never
        if token in MAYBE:
            return self._new(char, word, usual=False) if char.isupper() or not self.cased else never
        if self.cased:
            if not char.isupper():
                return never if char.islower() else SURE
            return SURE if len(word) > 1 or raw[:1] in "IAO" or not raw[1:2] == "." else never
        if not char.isupper() and not char.islower():
            return SURE
        return never if word in FILE_ENDINGS or self._odd_behind(end) else SURE

    def _quotation(self, i: int, bare: str, span: tuple[int, int], end: int) -> None:
        """A quotation or bracket that closes right behind a mark."""
        s, start = self.s, span[0]
        spaced, char, word = self._after(end)
        if not char:
            return
        if s[start] in BRACKETS:
            # On its own it is a sentence; a remark inside one does not end it.
            if char not in ",;:" and char not in MARKS:
                self._put(end, (start, SURE, -SURE * 3))
            return
        if char in ",;:" or char in MARKS or char in "-–—":
            return
        if bare == ".":
            token = self._token(i)
            if token in MAYBE or token in NEVER:
                return
        led = start
        while led and s[led - 1].isspace():
            led -= 1
        lead = s[led - 1 : led] in (",", ":", "：", "，", "、", "﹕") if led else False
        if self.cased and (char.isupper() or char.islower()):
            self._put(end, (start, SURE, SURE if lead else LIKELY) if char.isupper() else (start, -SURE * 3, -SURE * 3))
        elif char.isupper() or char.islower():
            said = word in SAYING or word in ONWARD
            self._put(end, (start, -SURE if said else LIKELY, -SURE if word in ONWARD else LIKELY if lead else -LIKELY))
        elif char.isalpha():
            # Scripts without case: words behind a quotation that opens the sentence attribute it; one led in by a colon ends it.
            self._put(end, (start, -SURE, SURE if lead else -SURE))
        else:
            self._put(end, (start, SURE, SURE if lead else LIKELY))


_WORD = re.compile(r"[^\W_]+(?:['’.][^\W_]+)*")
_INNER = re.compile(r"[^\w\s]+\s?")
_SPACES = re.compile(r"\s+")
_ODD = re.compile(r"[@/_\d]")
_STARTS = frozenset("the a an we they it he she i this that these those my our their his her what how why who when where if since for not no".split())


def s_opens(s: str, k: int) -> bool:
    """Whether a mark that both opens and closes seems to open here."""
    return k + 1 < len(s) and not s[k + 1].isspace() and s[k] not in ")]}»”’」』"


def _cut(s: str) -> list[int]:
    """Best segmentation of a block: ends of its sentences, without the last one.

    Semi-Markov: best[i] is the best sum over all ways to cut up to candidate i. A span's score is the sum of its closing words and the opening words behind
    them (the candidate's score, which depends on the span's start where it ends a quotation or bracket), the balance of quotations and brackets
    at both of its ends, its length, and whether it has any word. Marks in quotations and brackets are candidates like others;
    the balance is what keeps a sentence from ending at them. Spans over LONG_FROM pay by length, so that the best start for them is a running
    maximum and the search stays exact at any number of candidates.
    """
    block = _Block(s)
    ends, scores = block.ends, block.scores
    if not ends:
        return []
    if not any(block.split) and all(not isinstance(x, tuple) and x >= SURE for x in scores) and all(b - a > 12 for a, b in zip([0, *ends], [*ends, len(s)], strict=True)):
        # Nothing to weigh: every candidate is a sure end, and no span, the last one included, is empty or pays.
        return ends
    split = [0.0, *(SPLIT if x else 0.0 for x in block.split), 0.0]
    places = [0, *ends, len(s)]
    first = []
    for p in places:
        while p < len(s) and s[p].isspace():
            p += 1
        first.append(p)
    best = [0.0]
    back = [-1]
    # The two best starts of long spans, at different places of the text; the second stands in where the first opens a quotation or bracket.
    far, far_at, far2, far2_at, seen = float("-inf"), -1, float("-inf"), -1, 0
    for i in range(1, len(places)):
        p = places[i]
        score = scores[i - 1] if i <= len(ends) else 0.0
        while places[seen] < p - LONG_FROM:
            value = best[seen] + LONG * places[seen] - split[seen]
            if value > far:
                if far_at >= 0 and first[far_at] != first[seen]:
                    far2, far2_at = far, far_at
                far, far_at = value, seen
            elif value > far2 and first[far_at] != first[seen]:
                far2, far2_at = value, seen
            seen += 1
        top, top_at = float("-inf"), -1
        if far_at >= 0:
            paid = LONG * (p - LONG_FROM)
            if not isinstance(score, tuple):
                top, top_at = far - paid + score, far_at
            else:
                value, at = (far2, far2_at) if first[far_at] == score[0] else (far, far_at)
                if at >= 0:
                    top, top_at = value - paid + score[2], at
                # A long span that starts at the opening mark has its own score.
                for j in range(bisect_left(first, score[0], 0, seen), bisect_right(first, score[0], 0, seen)):
                    own = best[j] + LONG * places[j] - split[j] - paid + score[1]
                    if own > top:
                        top, top_at = own, j
        for j in range(seen, i):
            own = (score[1] if first[j] == score[0] else score[2]) if isinstance(score, tuple) else score
            if p - places[j] < 13 and not any(c.isalnum() for c in s[places[j] : p]):
                own += EMPTY
            own -= split[j]
            if best[j] + own > top:
                top, top_at = best[j] + own, j
        best.append(top - split[i])
        back.append(top_at)
    cuts = []
    i = back[-1]
    while i > 0:
        cuts.append(places[i])
        i = back[i]
    return cuts[::-1]


def sentences_of(text: str | None) -> list[tuple[int, int]]:
    """Half-open ranges of code points of a text's sentences, without white space at either end. Together they cover all else."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    for a, b, item in _blocks(text):
        s = text[a:b]
        at = 0
        for end in [*([] if item else _cut(s)), len(s)]:
            x, y = at, end
            while x < y and s[x].isspace():
                x += 1
            while y > x and s[y - 1].isspace():
                y -= 1
            if y > x:
                out.append((a + x, a + y))
            at = end
    return out


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_char, end_char): one row per sentence of every text, whatever its language and layout.

    Null, empty and blank texts have no rows; rows with a null key and repeated rows are kept. The text is one task's work, in time
    proportional to its length; texts are spread evenly before, as a file may hold a few very long ones next to each other.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                row, start, end = [], [], []
                for i, value in enumerate(part.column(1).to_pylist()):
                    for x, y in sentences_of(value):
                        row.append(i)
                        start.append(x)
                        end.append(y)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=[key, "start_char", "end_char"])

    rows = documents.select(key, text).where(F.col(text).isNotNull())
    width = max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(width, F.xxhash64(key, F.length(text))).mapInArrow(split, f"{key} {kind}, start_char int, end_char int")
