"""Sentence boundaries across languages and scripts, by document-centred disambiguation.

A full stop is ambiguous after an abbreviation, an initial or an ordinal. Whether
a word is an abbreviation is first asked of its other occurrences in the document
(a word that also stands without a stop is none), then of counts over the whole
corpus, which one distributed pass gathers, and only where both are silent of the
fixed lists. Whether an abbreviation's stop also ends the sentence depends on what
follows: a capitalised word that stands in lower case elsewhere starts a sentence,
a proper name does not. The same counts tell names that carry a mark ("the Tus!
shop"). Other marks are terminators of their script; layout (quote marks, lists,
signatures, code, tags) is read before the text. Texts are read in linear time.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import materialize, ship_package, spread

# Fixed values, asked last: abbreviations after which a sentence goes on, whatever follows; those whose stop may also end it,
# among them all that are ordinary words as well; verbs of speech behind a quote in scripts without case.
INNER = frozenset(
    "dr dra drs mr mrs ms prof st rev gen capt col lt sgt hon approx ed eds vs e.g i.e a.k.a mk cf pp ca viz "
    "vgl bzw z z.b d.h ggf inkl evtl sog bijv mevr dhr t.ex bl.a inż m.in np tzn "
    "m mme mlle pr p av env sr sra srta ej проф ул п см стр напр т е тел डॉ पृ श्री د ص".split()
)
FINAL = frozenset(
    "no nos fig figs tab vol art arts ee sect str nr abb ex éd chap núm pág им рис гр ср أ "
    "etc co ltd jr inc corp p.m a.m hrs cie cía usw uu v a al д др руб г гг тыс млн h uhr bros dept น".split()
)
SPEECH = regex.compile(r"चिल्लाया|पूछा|कहा|बोला|喊道|问道|说道|叫道|答道|ตะโกน|ถามว่า|กล่าว|صاح|سأل|قال|هتف")
VOWELS = "aeiouyäöüàáâéèêíîóôúûаеёиоуыэюя"
_ORDINAL_BEFORE = frozenset({"am", "der", "im", "zum", "vom", "den", "dem", "das", "die", "ab", "bis", "seit", "zur"})

_TAG = regex.compile(r"</?[A-Za-z][^<>]{0,80}>|\[/?[A-Za-z]+(?:=[^\[\]]{0,80})?\]")
_CLOSE_TAG = regex.compile(r"</[A-Za-z][^<>]{0,80}>|\[/[A-Za-z]+\]")
_ONLY_TAGS = regex.compile(rf"\s*+(?:(?:{_TAG.pattern})\s*+)+")
_URL = regex.compile(r"(?:https?://|www\.)[^\s<>\[\]\"“”«»]+", regex.I)
# Terminators of all scripts; a semicolon behind a Greek letter is its question mark.
_MARKS = regex.compile(r"[\p{Sentence_Terminal}…．｡\u037E]+|(?<=[\p{Greek}]);")
_MARKS_ASCII = regex.compile(r"[.!?]+")
_INVISIBLE = regex.compile("[\u00AD\u200B-\u200F\u202A-\u202E\u2060\uFEFF]")
_EMOJI = regex.compile(
    r"(?:\p{Emoji_Presentation}|\p{Extended_Pictographic})(?:[\uFE0F\u200D\U0001F3FB-\U0001F3FF]|\p{Emoji_Presentation}|\p{Extended_Pictographic})*"
    r"|[:;=8][-o^']?[)(DPp\]\[/\\|](?![\p{L}\p{N}])|<3|\^\^"
)
_BREAK = regex.compile(r"\r\n|\r|\n")
_QUOTE_MARKS = regex.compile(r"[ \t]*(?:>[ \t]?)+")
_SIGNATURE = regex.compile(r"\s*[-_~]{2,}\s*")
_BULLET = regex.compile(r"[ \t]*(?:[-*•‣·–][ \t]+|(\d{1,3})[.)][ \t]+|[a-z]\)[ \t]+)(?=\S)")
_THAI_SPACE = regex.compile(rf"(?<=[\p{{Thai}}\p{{P}}])(?P<face>(?:[ \u00A0\u3000]*(?:{_EMOJI.pattern}))*)(?P<gap>[ \u00A0\u3000]+)(?=[\p{{Thai}}“\"(])")
_CODE_OPEN, _CODE_CLOSE = regex.compile(r"\[code\]", regex.I), regex.compile(r"\[/code\]", regex.I)
_QUOTE_OPEN = regex.compile(r"\s*(?:\[quote|<blockquote)", regex.I)
_NEXT_WORD = regex.compile(r"[\p{L}\p{M}\u00AD\u200B-\u200D\u2060]+")
_WORD_AFTER = regex.compile(r"[\p{L}\p{M}\p{N}.\-/'’]+")
_WORD_END = regex.compile(r"(?:\p{Ll}{3}|\d)$")
_ROMAN = regex.compile(r"[IVXLC]{2,}(?![A-Za-z])")
_THAI = regex.compile(r"\p{Thai}")
_SPACES = regex.compile(r"\s*")
_GAP = regex.compile(r"[ \t\u00A0\u2009\u202F\u3000\n]*")
# Words read backwards from a mark: with inner stops, hyphens and invisible characters; the word before a number; a name behind its article.
_WORD_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}.'’\-\u00AD\u200B-\u200D\u2060\uFEFF]*")
_LAST_WORD = regex.compile(r"(?r)\p{L}+\s+")
_BEFORE_V = regex.compile(r"(?r)\be\.\s+")
_STOPPED = regex.compile(r"(?r)(?<![\p{L}\p{M}\p{N}])(?:[\p{L}\p{M}]\.)*[\p{L}\p{M}]+")
_CAPITALISED = regex.compile(r"(?r)(?<![\p{L}\p{M}])\p{Lu}[\p{L}\p{M}]*")
_THE_NAME = regex.compile(r"(?r)\b(?:the|THE)[\s>\u00A0]+\p{Lu}[\p{L}\p{M}]*")
_WORD = regex.compile(r"[\p{L}\p{M}]++")
# A word right before a stop, and one before a capital or a digit, where it may be an abbreviation without its stop (Dr Fen, no 5).
_BEFORE_STOP = regex.compile(r"(?r)([\p{L}\p{M}]+)\.")
_BEFORE_CAPITAL = regex.compile(r"(?r)([\p{L}\p{M}]+)[\s>\u00A0\u200B]+(?=[\p{Lu}\p{Nd}])")
_CAPITAL_AHEAD = regex.compile(r"\.|[\s>\u00A0\u200B]+[\p{Lu}\p{Nd}]")
_STOP = regex.compile(r"(?<=[\p{L}\p{M}])\.(?=[\s,;:])[\s>\u00A0]*+")
_WITHIN = regex.compile(r"(?<=[\p{Ll},][\s>\u00A0]{1,3})\p{Lu}[\p{L}\p{M}]+")
_BEHIND_NAME = regex.compile(r"(?<=[\p{Ll},][\s>\u00A0]{1,3})\p{Lu}[\p{L}\p{M}]*+[!?][\s>\u00A0]++(\p{Ll}[\p{L}\p{M}]*+)")
_BEHIND_QUOTE = regex.compile(r"[.!?…](?:[”\"»“]|[ \u00A0\u202F]»)[\s>\u00A0]++([\p{L}\p{M}]++)")
_BEHIND_MARK = regex.compile(r"[.!?…][\s>\u00A0]++(\p{Ll}[\p{L}\p{M}]*+)")
_FULL_STOP, _AFTER_MARK = regex.compile(r"[.．]"), regex.compile(r"[!?][^\p{L}\p{N}]*([\p{L}\p{M}\u00AD\u200B-\u200D\u2060]+)")
# What may not stand before a speaker behind a quote: the end of a sentence, another quote, or the colon before one.
_CLAUSE = regex.compile(r"[^。！？!?।….\n“「«：:]+")
_NO_CASE = regex.compile(r"(?![ªº])[\p{Lo}\p{M}\p{Thai}\p{Arabic}\p{Devanagari}]")
_LOWER, _VISIBLE = regex.compile(r"\p{Ll}"), regex.compile(r"[^ \t\n\u00A0]")
_SOLID, _WORDLY = regex.compile(r"[^ \t\n(（\u00A0]"), regex.compile(r"[^ \t\n\"“„«»*\-_'()]")
_OPENERS, _CLOSERS = "\"“„«‘「『(（[【¿¡", "\"”“’'»›)）]】」』"
_PAIR = {")": "(", "）": "（", "]": "[", "】": "【", "”": "“„", "“": "„", "»": "«", "」": "「", "』": "『", "’": "‘"}
_IN_WORD = regex.compile(r"[\p{L}\p{M}]")
#: Words of a document that are looked for one by one before all its words are counted.
MOST_SCANS = 32
#: A word with inner stops that is longer is judged by its last part, so that reading back from each of its stops stays linear.
LONGEST_DOTTED = 64


@lru_cache(1 << 16)
def plain(word: str) -> str:
    """A word's form for lookups: no invisible characters, compatibility forms unified, case folded."""
    if word.isascii():
        return word.lower()
    return unicodedata.normalize("NFKC", _INVISIBLE.sub("", word)).casefold()


#: Words of the corpus that are broadcast; more of them are joined to the documents.
HELD_WORDS = 200_000

# --- evidence ---------------------------------------------------------------

#: Of a word: occurrences without a stop; with one before more of the sentence; before a capitalised common word; before another
#: capitalised word; behind a stop in capitals; in lower case; within a sentence in capitals. Documents that show it as an abbreviation.
#: Of ``!word``, a word in lower case behind a mark: ``goes_on`` behind a name within a sentence, ``bare`` behind any mark.
#: Of ``"word``, a word behind a quote that ends in a mark: ``goes_on`` in lower case, ``bare`` in capitals.
KINDS = ("bare", "goes_on", "common", "name", "after", "lower", "within", "asked")


def stops(text: str) -> Iterator[tuple[str, int]]:
    """Words before a full stop, with the place of what follows it."""
    for m in _STOP.finditer(text):
        at = m.end()
        if at < len(text):
            word = _STOPPED.match(text, max(0, m.start() - LONGEST_DOTTED), m.start())
            if word:
                yield word.group(), at


class Occurrences:
    """Counts of words over many texts."""

    def __init__(self) -> None:
        self.tokens: Counter = Counter()
        self.held: Counter = Counter()
        self.within: Counter = Counter()
        self.behind: Counter = Counter()
        self.counts: Counter = Counter()

    def add(self, text: str) -> None:
        tokens = _WORD.findall(text)
        held = _BEFORE_CAPITAL.findall(text) + _BEFORE_STOP.findall(text)
        self.tokens.update(tokens)
        self.held.update(held)
        self.within.update(_WITHIN.findall(text))
        counts = self.counts
        words: set[str] = set()
        went_on: dict[str, int] = {}
        for raw, at in stops(text):
            word, c = plain(raw), text[at]
            if c.islower() or c.isdigit() or c in ",;:":
                went_on[word] = went_on.get(word, 0) + 1
            elif c.isupper():
                words = words or set(tokens)
                follower = _NEXT_WORD.match(text, at)
                common = follower is not None and follower.group().lower() in words
                counts[word, "common" if common else "name"] += 1
                if follower is not None:
                    counts[plain(follower.group()), "after"] += 1
        for word, n in went_on.items():
            counts[word, "goes_on"] += n
            if n > 1 and sum(plain(w) == word for w in tokens) == sum(plain(w) == word for w in held):
                counts[word, "asked"] += 1
        if "!" in text or "?" in text:
            self.behind.update(_BEHIND_NAME.findall(text))
        counts.update(("!" + plain(w), "bare") for w in _BEHIND_MARK.findall(text))
        if "”" in text or '"' in text or "»" in text or "“" in text:
            for word in _BEHIND_QUOTE.findall(text):
                counts['"' + plain(word), "goes_on" if word.islower() else "bare"] += 1

    def total(self) -> Counter:
        """Counts by (word, kind)."""
        counts = self.counts.copy()
        for raw, n in self.tokens.items():
            word = plain(raw)
            if free := n - self.held[raw]:
                counts[word, "bare"] += free
            if raw.islower():
                counts[word, "lower"] += n
        for raw, n in self.within.items():
            counts[plain(raw), "within"] += n
        for raw, n in self.behind.items():
            counts["!" + plain(raw), "goes_on"] += n
        return counts


def corpus_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, one column for each of ``KINDS``) over the whole corpus; batches are combined before the exchange."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Occurrences()
            for t in batch.column(0).to_pylist():
                seen.add(t)
            total = seen.total()
            words = sorted({w for w, _ in total})
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), *(pa.array([total[w, k] for w in words], pa.int64()) for k in KINDS)], names=["word", *KINDS]
            )

    rows = spread(docs.select(F.col(text).alias("t")).filter("t is not null")).mapInArrow(run, "word string, " + ", ".join(f"{k} bigint" for k in KINDS))
    return rows.groupBy("word").agg(*[F.sum(k).alias(k) for k in KINDS])


def lexicon(counts: DataFrame) -> DataFrame:
    """(word, kind, name): what the corpus shows of words before a stop, and of capitalised words behind one.

    ``kind`` is ``inner``, ``final``, ``open``, ``plain``, ``inside`` or null. A word is an
    abbreviation if it has five stops at least, hardly ever stands without one, and
    its stop is often followed by more of the sentence or, for a word that is short or
    has no vowel, by names. Too few capitals behind it leave ``open`` whether its
    stop may end a sentence. A word of the fixed lists, or one that some document shows
    as an abbreviation, is ``plain`` if it stands without a stop more often than with
    one. ``name`` holds for words that stand within sentences in capitals and never
    in lower case. The rules are shares and fixed counts, so that a word's
    evidence does not fade as the corpus grows. Of a listed ``final`` word it is enough
    that common words in capitals follow its stop: sentences start there, with names too.
    ``inside`` holds for ``!word`` if most marks before the word belong to a name, and for
    ``"word`` if most quotes before it go on with it.
    """
    stops = F.col("goes_on") + F.col("common") + F.col("name")
    clipped = (F.length("word") <= 2) | ~F.col("word").rlike(f"[{VOWELS}]")
    goes_on = F.col("goes_on") * 10 > stops * 3
    sure = (stops >= 5) & (F.col("bare") * 25 < stops) & (goes_on | clipped & (F.col("name") * 5 > stops * 2))
    asked = (F.col("asked") > 0) | F.col("word").isin(sorted(w for w in INNER | FINAL if len(w) > 1))
    plain_use = asked & (F.col("bare") >= 5) & (F.col("bare") > stops)
    capitals = F.col("common") + F.col("name")
    ends = F.col("common") * 10 > capitals
    kind = F.when(sure & ((capitals < 5) | ends & (capitals * 20 < stops)), "open").when(sure & ends, "final").when(sure, "inner").when(plain_use, "plain")
    kind = kind.when(F.col("word").isin(sorted(FINAL)) & (F.col("common") >= 5) & ends, "final")
    marked = F.col("word").rlike('^[!"]')
    inside = marked & (F.col("goes_on") >= 5) & (F.col("goes_on") * 2 > F.col("bare"))
    name = (F.col("after") > 0) & (F.col("within") > 0) & (F.col("lower") == 0)
    return counts.select("word", F.when(inside, "inside").when(~marked, kind).alias("kind"), name.alias("is_name")).filter("kind is not null or is_name")

# --- layout -----------------------------------------------------------------


class Block:
    """Text of consecutive lines without their quote marks, with the place of each character."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.starts: list[int] = []
        self.places: list[int] = []
        self.size = 0

    def add(self, content: str, place: int) -> None:
        if self.parts:
            self.parts.append("\n")
            self.size += 1
        self.starts.append(self.size)
        self.places.append(place)
        self.parts.append(content)
        self.size += len(content)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def place(self, at: int) -> int:
        i = bisect_right(self.starts, at) - 1
        return self.places[i] + at - self.starts[i]


def layout(text: str) -> Iterator[tuple[str, Block]]:
    """Blocks of a text in order: ``text`` to be cut, ``whole`` units of one piece."""
    lines = []
    at = 0
    breaks = [m.span() for m in _BREAK.finditer(text)]
    for end, following in [*breaks, (len(text), len(text))]:
        if at == len(text):
            break
        raw = text[at:end]
        marks = _QUOTE_MARKS.match(raw) if ">" in raw else None
        start = marks.end() if marks else 0
        lines.append((marks.group().count(">") if marks else 0, raw[start:], at + start))
        at = following
    invisible = not text.isascii() and _INVISIBLE.search(text) is not None
    has_code = _CODE_OPEN.search(text) is not None
    block: Block | None = None
    depth, in_list, number = 0, False, None
    i = 0
    while i < len(lines):
        level, content, place = lines[i]
        bare = _INVISIBLE.sub("", content).strip() if invisible else content.strip()
        opened = _CODE_OPEN.search(content) if has_code else None
        signature = bare[:1] in ("-", "_", "~") and _SIGNATURE.fullmatch(content) is not None
        only_tags = bare[-1:] in (">", "]") and _ONLY_TAGS.fullmatch(content) is not None
        if block is not None and (level != depth or not bare or signature or only_tags or opened):
            if opened and level == depth and content[: opened.start()].strip():
                pass
            else:
                yield "text", block
                block = None
        if not bare:
            in_list, number = False, None
            i += 1
            continue
        if opened:
            if content[: opened.start()].strip():
                block = block or Block()
                block.add(content[: opened.start()], place)
                yield "text", block
                block = None
            code = Block()
            rest, rest_place = content[opened.start() :], place + opened.start()
            while True:
                closed = _CODE_CLOSE.search(rest)
                if closed:
                    code.add(rest[: closed.end()], rest_place)
                    rest, rest_place = rest[closed.end() :], rest_place + closed.end()
                    break
                code.add(rest, rest_place)
                i += 1
                if i >= len(lines):
                    rest = ""
                    break
                _, rest, rest_place = lines[i]
            yield "whole", code
            if rest.strip():
                lines[i] = (level, rest, rest_place)
                depth = level
                continue
            i += 1
            depth = level
            continue
        if only_tags:
            in_list, number = False, None
            i += 1
            continue
        if signature:
            block = Block()
            while i < len(lines) and lines[i][0] == level and lines[i][1].strip():
                block.add(lines[i][1], lines[i][2])
                i += 1
            yield "whole", block
            block = None
            continue
        if bare.endswith((":", "：")) and i + 1 < len(lines):
            deeper, following, _ = lines[i + 1]
            if deeper > level or _QUOTE_OPEN.match(following):
                if block is not None:
                    yield "text", block
                block = Block()
                block.add(content, place)
                yield "whole", block
                block = None
                depth, in_list, number = level, False, None
                i += 1
                continue
        item = _BULLET.match(content) if bare[0] in "-*•‣·–0123456789" or not bare[0].isascii() or bare[1:2] == ")" else None
        if item:
            given = int(item.group(1)) if item.group(1) else None
            if block is None or in_list and (given is None or number is None or given == number + 1):
                starts = True
            else:
                before = block.text.rstrip()
                starts = given is None and not content.lstrip().startswith("–") and before.endswith((".", "!", "?", "…", "。", "！", "？", ":", "：", "।", ")"))
            if starts:
                if block is not None:
                    yield "text", block
                    block = None
                in_list, number = True, given
        if block is None:
            block = Block()
            depth = level
            if item and item.end() < len(content):
                content, place = content[item.end() :], place + item.end()
        block.add(content, place)
        i += 1
    if block is not None:
        yield "text", block


# --- sentences within a block -----------------------------------------------


class Words:
    """What the words of one document show of each other.

    A few words are looked for one by one; a document that asks about more is counted whole, once.
    """

    def __init__(self, text: str):
        self.text = text
        self._goes_on: Counter | None = None
        self._within: set[str] = set()
        self._low = ""
        self._bare: dict[str, int] | None = None
        self._lower: set[str] = set()
        self.scans = 0

    def goes_on(self, word: str) -> int:
        """How often a word stands with a stop before more of the sentence."""
        if self._goes_on is None:
            text = self.text
            self._goes_on = Counter(plain(raw) for raw, at in stops(text) if (c := text[at]).islower() or c.isdigit() or c in ",;:")
        return self._goes_on[word]

    def bare(self, word: str) -> int:
        """How often a word stands without a stop, but for places before a capital or a digit."""
        if self._scan():
            self._low = self._low or self.text.lower()
            return sum(_CAPITAL_AHEAD.match(self.text, end) is None for end in self._ends(self._low, word)) if len(self._low) == len(self.text) else self._count()[word]
        return self._count()[word]

    def is_name(self, word: str) -> bool | None:
        """Whether a word is a proper name here: within sentences in capitals and nowhere in lower case; None if it is in neither."""
        if not self._within:
            self._within = {"", *(w.lower() for w in _WITHIN.findall(self.text))}
        if self._scan():
            lower = next(self._ends(self.text, word), None) is not None
        else:
            self._count()
            lower = word in self._lower
        return False if lower else True if word in self._within else None

    def _scan(self) -> bool:
        self.scans += 1
        return self._bare is None and self.scans <= MOST_SCANS

    @staticmethod
    def _ends(text: str, word: str) -> Iterator[int]:
        """Ends of a word's occurrences as a whole word."""
        at = text.find(word)
        while at >= 0:
            end = at + len(word)
            if not (at and _IN_WORD.match(text, at - 1)) and not _IN_WORD.match(text, end):
                yield end
            at = text.find(word, end)

    def _count(self) -> dict[str, int]:
        if self._bare is None:
            self._bare = Counter(w.lower() for w in _WORD.findall(self.text))
            for pattern in (_BEFORE_CAPITAL, _BEFORE_STOP):
                self._bare.subtract(w.lower() for w in pattern.findall(self.text))
            self._lower = {w for w in _WORD.findall(self.text) if w.islower()}
        return self._bare


class Places:
    """Where characters stand in a text, for counts between two places without reading what lies between."""

    def __init__(self, s: str):
        self.s = s
        self._at: dict[str, list[int]] = {}

    def _of(self, what: str) -> list[int]:
        if what not in self._at:
            places, at = [], self.s.find(what)
            while at >= 0:
                places.append(at)
                at = self.s.find(what, at + len(what))
            self._at[what] = places
        return self._at[what]

    def count(self, what: str, start: int, end: int) -> int:
        places = self._of(what)
        return bisect_left(places, end) - bisect_left(places, start)

    def last(self, what: str, start: int, end: int) -> int:
        places = self._of(what)
        i = bisect_left(places, end) - 1
        return places[i] if i >= 0 and places[i] >= start else -1


class Splitter:
    """Cuts the texts of one document; ``corpus`` gives the kind and the name flag of words in the corpus."""

    def __init__(self, text: str, corpus: dict[str, tuple[str | None, bool]]):
        self.words, self.corpus = Words(text), corpus
        self._kinds: dict[str, str | None] = {}

    def kind(self, word: str) -> str | None:
        """Of a word before a stop: ``inner``, ``final`` or no abbreviation; ``open`` if what follows decides whether its stop ends the sentence.

        The document is asked first, then the corpus, then the fixed lists.
        """
        if word not in self._kinds:
            self._kinds[word] = self._kind(word)
        return self._kinds[word]

    def _kind(self, word: str) -> str | None:
        letters = word.replace(".", "")
        listed = "inner" if word in INNER else "final" if word in FINAL else None
        if listed is None and "." in word and letters.isalpha() and len(letters) <= 4 and all(len(p) == 1 for p in word.split(".")):
            listed = "final"
        if len(letters) < 2 or not all(c.isalpha() or unicodedata.category(c)[0] == "M" for c in letters):
            return listed
        held = self.corpus.get(word, (None, False))[0]
        goes_on = self.words.goes_on(word)
        if listed is None and held in (None, "plain") and goes_on < 2:
            return None  # no abbreviation, whatever the document has of it without a stop
        bare = 0 if "." in word else self.words.bare(word)
        if bare > goes_on:  # an ordinary word here; a listed one may still go on before a digit or in lower case
            return "final" if listed else None
        if held == "plain":
            return "final" if listed else None
        if held in ("inner", "final"):
            return held
        if listed == "inner":
            return listed
        return "open" if listed or held == "open" or goes_on >= 2 and not bare else None

    def is_name(self, s: str, at: int) -> bool:
        """Whether the capitalised word ahead is a proper name in the document or, if that does not tell, in the corpus."""
        m = _NEXT_WORD.search(s, at)
        word = plain(m.group()) if m else ""
        if len(word) < 2:
            return False
        here = self.words.is_name(word)
        return self.corpus.get(word, (None, False))[1] if here is None else here

    def ends(self, block: Block) -> Iterator[int]:
        s = self.s = block.text
        self.places = Places(s)
        ascii_only = s.isascii()
        hidden: list[tuple[int, int]] = []
        if "<" in s or "[" in s:
            hidden = [m.span() for m in _TAG.finditer(s)]
        if "://" in s or "www." in s or "WWW." in s:
            for m in _URL.finditer(s):
                end = m.end()
                while end > m.start() and s[end - 1] in ".,;:!?…)»'":
                    end -= 1
                hidden.append((m.start(), end))
            hidden.sort()
        closed_to, h = 0, 0
        start = 0
        cuts: list[int] = []
        for m in (_MARKS_ASCII if ascii_only else _MARKS).finditer(s):
            i = m.start()
            while h < len(hidden) and hidden[h][1] <= i:
                h += 1
            if i < closed_to or (h < len(hidden) and hidden[h][0] <= i):
                continue
            cut = self.boundary(s, start, i, m.end())
            if cut is not None:
                cuts.append(cut)
                closed_to = start = cut
        if not ascii_only and _THAI.search(s):
            spans = sorted(hidden)
            starts = [a for a, _ in spans]
            for m in _THAI_SPACE.finditer(s):
                before = bisect_right(starts, m.start()) - 1
                if not (before >= 0 and m.start() < spans[before][1]) and self._thai_cut(s, m):
                    cuts.append(m.start("gap"))
            cuts = sorted(set(cuts))
        invisible = not ascii_only and _INVISIBLE.search(s) is not None
        start = 0
        for cut in [*cuts, len(s)]:
            body = s[start:cut].rstrip()
            bare = _INVISIBLE.sub("", body).strip() if invisible else body.strip()
            if bare and not (bare[-1] in ">]" and bare[0] in "<[" and _ONLY_TAGS.fullmatch(bare)):
                yield block.place(start + len(body) - 1) + 1
            start = cut

    @staticmethod
    def _thai_cut(s: str, m) -> bool:
        before, after = s[m.start() - 1], s[m.end()]
        if "ๆ" in (before, after) or before.isdigit() or after.isdigit() or before in "“\"(«,":
            return False
        return _THAI.search(s, max(0, m.start() - 3), m.start()) is not None

    def boundary(self, s: str, start: int, i: int, j: int) -> int | None:
        """Where the unit ends if the marks s[i:j] end one, else None."""
        run = s[i:j].replace("．", ".")
        prev = s[i - 1] if i else " "
        nxt = s[j] if j < len(s) else ""
        single = run == "."
        ellipsis = not single and not run.strip(".…")
        if single:
            if nxt.isdigit() and (prev.isdigit() or prev.isspace()):
                return None
            if nxt.isalpha() and not self._joined(s, i, j):
                return None
        elif nxt.isalnum() and not run.strip("!?.…") and not (nxt.isupper() or _NO_CASE.match(nxt) or ellipsis):
            return None
        k, quoted, opened_inside, bracket_inside = self._close(s, start, j)
        at, following = self._first(s, k)
        if not following:
            return k
        ahead = _SPACES.match(s, k).end()
        lead = s[ahead : ahead + 1]
        if lead in (",", ";", "،") or (lead in ("—", "–") and (quoted or not following.isupper())):
            return None
        if bracket_inside and (not following.isupper() or self._shouted(s, start, k, at)):
            return None
        if quoted and (self._speaker(s, ahead, opened_inside, following) or not opened_inside and self._shouted_speaker(s, start, k, ahead)):
            return None
        if ellipsis:
            return None if following.islower() else k
        if single:
            return k if self._stop_ends(s, start, i, following, k, ahead) else None
        if not quoted and (run == "!" or run == "?") and self._within_name(s, start, i, ahead):
            return None
        return k

    def _within_name(self, s: str, start: int, i: int, ahead: int) -> bool:
        """Whether the mark at i belongs to a name within the sentence ("the Tus! shop"): by what follows names with a mark
        elsewhere, or else by the article before it."""
        word = _NEXT_WORD.match(s, ahead)
        if word is None or not (word.group().islower() or word.group().isupper() and self._shouted(s, start, i, ahead)):
            return False
        if self.corpus.get("!" + plain(word.group()), (None, False))[0] == "inside":
            return word.group().isupper() or _CAPITALISED.match(s, start, i) is not None
        return s[i] == "!" and word.group().islower() and _THE_NAME.match(s, start, i) is not None

    @staticmethod
    def _shouted(s: str, start: int, end: int, at: int) -> bool:
        """Whether s[start:end] and the word ahead are in capitals, so that they say nothing about its sentences."""
        word = _NEXT_WORD.search(s, at)
        return bool(word) and len(word.group()) > 1 and word.group().isupper() and _LOWER.search(s, start, end) is None

    @staticmethod
    def _first(s: str, at: int) -> tuple[int, str]:
        """The first letter or digit ahead, past openers, tags and spaces, with its place; another sign if that comes first."""
        while at < len(s):
            c = s[at]
            if c.isalnum():
                return at, c
            tag = _TAG.match(s, at) if c in "<[" else None
            if tag:
                at = tag.end()
            elif c == "&" and (s.startswith("&quot;", at) or s.startswith("&nbsp;", at)):
                at += 6
            elif c.isspace() or c in _OPENERS or c in "'*_" or _INVISIBLE.match(c):
                at += 1
            else:
                return at, c
        return at, ""

    def _joined(self, s: str, i: int, j: int) -> bool:
        """Whether a stop with a letter right behind it stands between two sentences."""
        before = _WORD_BEFORE.match(s, max(0, i - LONGEST_DOTTED), i)
        word = before.group() if before else ""
        nxt = s[j]
        if _NO_CASE.match(nxt):
            return bool(word) and bool(_NO_CASE.match(word[-1])) and plain(word) not in FINAL and not _THAI.match(nxt)
        if _ROMAN.match(s, j):
            return False
        if not nxt.isupper() or not word:
            return not word and i > 0 and s[i - 1] in _CLOSERS and nxt.isupper()
        if "." in word and not _WORD_END.search(word):
            return False
        tail = word.rsplit(".", 1)[-1]
        if len(plain(tail)) < 2 and not tail.isdigit():
            return False
        if self.kind(plain(tail)) == "inner":
            return False
        if word.isupper() and s[j : j + 2].isupper():
            after = _WORD_AFTER.match(s, j)
            if len(after.group()) > 1 and after.group()[:2].isupper():
                return False
        return True

    def _close(self, s: str, start: int, j: int) -> tuple[int, bool, bool, bool]:
        """Past what follows the marks and belongs to them.

        Gives the end, whether a quote was closed, whether that quote or bracket
        had opened inside the sentence, and whether a bracket did.
        """
        k, quoted, inside, bracket = j, False, False, False
        while k < len(s):
            at = _GAP.match(s, k).end()
            spaced = at > k
            if at >= len(s):
                break
            c = s[at]
            if c.isalnum():
                break
            if c == "&" and s.startswith("&quot;", at):
                if self.places.count("&quot;", start, k) % 2 == 1:
                    quoted, k = True, at + 6
                    continue
                break
            if c in "<[":
                tag = _CLOSE_TAG.match(s, at)
                if tag:
                    k = tag.end()
                    continue
            if c == '"':
                if self.places.count('"', start, k) % 2 == 1:
                    inside |= _SOLID.search(s, start, self.places.last('"', start, k)) is not None
                    quoted, k = True, at + 1
                    continue
                break
            if c in _CLOSERS and (not spaced or c in "»”」』)）]】"):
                opener = _PAIR.get(c)
                if opener is not None:
                    where = max(self.places.last(o, start, k) for o in opener)
                    if where < 0:
                        if spaced or c == "“":
                            break
                    else:
                        if c == "“" and spaced:
                            break
                        within = _VISIBLE.search(s, start, where) is not None
                        inside |= within
                        bracket |= within and c in ")）]】"
                    if c not in ")）]】’":
                        quoted = True
                elif spaced:
                    break
                k = at + 1
                continue
            face = _EMOJI.match(s, at)
            if face:
                k = face.end()
                continue
            break
        return k, quoted, inside, bracket

    @staticmethod
    def _speaker(s: str, at: int, inside: bool, following: str) -> bool:
        """Whether the words at ``at``, behind a closed quote, belong to it."""
        first = s[at : at + 1]
        if first and first in "—–,":
            return True
        if inside:  # the speaker came first
            return False
        if s.startswith(("と", "って"), at):
            return True
        if following.islower() and first.islower():
            return True
        if not first or not _NO_CASE.match(first):
            return False
        clause = _CLAUSE.match(s, at)
        return bool(clause) and s[clause.end() : clause.end() + 1] not in ("“", "「", "«", "：", ":") and bool(SPEECH.search(s, at, clause.end()))

    def _shouted_speaker(self, s: str, start: int, end: int, at: int) -> bool:
        """Whether words in capitals behind a closed quote belong to it, as they do elsewhere in lower case."""
        word = _NEXT_WORD.match(s, at)
        return word is not None and self.corpus.get('"' + plain(word.group()), (None, False))[0] == "inside" and self._shouted(s, start, end, at)

    def _stop_ends(self, s: str, start: int, i: int, following: str, k: int, ahead: int) -> bool:
        """Whether a single full stop at i ends the sentence; k is the place behind what belongs to it."""
        m = _WORD_BEFORE.match(s, max(0, i - LONGEST_DOTTED), i)
        if not m:
            return True
        raw = m.group()
        word = plain(raw).replace("’", "'").strip("'-").rsplit("'", 1)[-1]
        opens = following.isupper() or bool(_NO_CASE.match(following)) or not following.isalnum()
        if word.isdigit():
            before = _LAST_WORD.match(s, start, m.start())
            if len(word) <= 2 and before and plain(before.group().rstrip()) in _ORDINAL_BEFORE and following.isalpha():
                return False
            return _WORDLY.search(s, start, m.start()) is not None
        letters = raw.replace(".", "")
        if len(letters) == 1 and letters.isalpha() and not _NO_CASE.match(letters):
            if letters.isupper():
                if word == "v" and _BEFORE_V.match(s, start, m.start()):
                    return opens
                return False
            if word not in FINAL:
                return False
        kind = self.kind(word)
        if kind == "inner":
            return False
        if kind == "open":
            return opens and not (s[ahead : ahead + 1].isupper() and self.is_name(s, k))
        if kind == "final":
            return opens
        return True


def sentence_ends(text: str, corpus: dict[str, tuple[str | None, bool]] | None = None) -> list[int]:
    """End positions, in code points, of the sentence units of a text."""
    if not text or not text.strip():
        return []
    splitter = Splitter(text, corpus or {})
    out: list[int] = []
    for kind, block in layout(text):
        if kind == "whole":
            s = block.text
            body = s.rstrip()
            if body:
                out.append(block.place(len(body) - 1) + 1)
        else:
            out.extend(splitter.ends(block))
    return sorted(set(out))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, end_pos): one row for each sentence unit of each text.

    ``end_pos`` counts the code points from the start of the text through the
    unit's last character that is not white space. Null, empty and blank texts
    have no units; texts of any length are read whole; a repeated row gives its
    units again; an empty table gives no rows. Two passes: corpus counts, then a
    map with what they show of its words: broadcast up to ``HELD_WORDS``, else joined
    to the documents that hold them. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    known = materialize(lexicon(corpus_counts(docs, text)), "lexicon")
    rows = spread(docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).filter("t is not null"))
    shipped = None
    if known.count() <= HELD_WORDS:
        shipped = spark.sparkContext.broadcast({r["word"]: (r["kind"], r["is_name"]) for r in known.collect()})
    else:
        rows = with_words(rows, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[int] = []
            ends: list[int] = []
            held = batch.column(2).to_pylist() if shipped is None else [None] * batch.num_rows
            for k, t, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), held):
                own = sentence_ends(t, shipped.value if shipped is not None else {w["word"]: (w["kind"], w["is_name"]) for w in words or ()})
                keys += [k] * len(own)
                ends += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ends, pa.int64())], names=[key, "end_pos"])

    return rows.mapInArrow(run, f"`{key}` bigint, end_pos bigint")


def asked_words(text: str) -> set[str]:
    """Words of a document that the corpus may be asked about: those before a stop, capitalised ones, and those behind a mark."""
    found = (_WORD_BEFORE.match(text, max(0, m.start() - LONGEST_DOTTED), m.start()) for m in _FULL_STOP.finditer(text))
    words = {plain(m.group()).replace("’", "'").strip("'-").rsplit("'", 1)[-1] for m in found if m}
    marked = {f"{mark}{plain(w)}" for mark in '!"' for w in _AFTER_MARK.findall(_TAG.sub("", text))}
    return words | {w.rsplit(".", 1)[-1] for w in words} | {plain(w) for w in _NEXT_WORD.findall(text) if _INVISIBLE.sub("", w)[:1].isupper()} | marked


def with_words(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(k, t, words): each text with the entries of ``known`` for its words; equal texts share them."""
    rows = rows.withColumn("h", F.sha2("t", 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(h, w) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in asked_words(t)]
            cols = zip(*pairs) if pairs else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["h", "word"])

    pairs = rows.select("h", "t").mapInArrow(run, "h string, word string").join(known, "word")
    # As a set: copies of a text would gather their words once for each copy.
    words = pairs.groupBy("h").agg(F.collect_set(F.struct("word", "kind", "is_name")).alias("words"))
    return rows.join(words, "h", "left").select("k", "t", "words")
