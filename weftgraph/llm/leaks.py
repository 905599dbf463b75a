"""Evaluation passages in corpus texts, by template canonicalisation.

Texts are normalised and turned into words (characters for scripts without
spaces). Numbers, names and units become typed placeholders, so a window of words
becomes a template. The templates of the items' windows make a table, which is hash-joined
with that of the corpus's windows. Each meeting is checked slot by slot: equal
slots make a leak, slots that differ but by a one-to-one replacement make a
re-parameterised copy. Both are equalities of hashes: of all words of the window, and of which
of its slots hold the same word as an earlier one.

No leak is lost: a word's class is looked up in the words of all items first, so a
window of the same words has the same template on both sides. The corpus is read
once, however many items there are; of its windows those reach the join that pass a
filter of bounded size over the items' templates.
"""

from __future__ import annotations

import hashlib
import html
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.skew import hot_keys, salted_lookup
from weftgraph.session import materialize, ship_package, spread

#: Consecutive words, or characters in scripts without spaces, that make a leak.
WORD_WINDOW, CHAR_WINDOW = 12, 40
#: Words, or characters, of a window that must not be placeholders for a re-parameterised copy.
LEAST_PLAIN, LEAST_PLAIN_CHARS = 7, 24
#: Words of the items that are broadcast as they are, 8 bytes each; more become a filter of ``MOST_BITS``.
MOST_WORDS = 4_000_000
#: Bits of a broadcast filter, at most (64 MB).
MOST_BITS = 1 << 29
#: Different words a task remembers; beyond, it starts anew. Units of texts that are read at once; a longer text is read whole all the same.
MOST_HELD, MOST_UNITS = 500_000, 100_000
# Languages written without spaces between words, and words that are units.
CHAR_LANGS = ("zh", "ja", "th")
UNITS = frozenset(
    "mm cm m km in ft g kg lb t ml l bar psi v w kw a s sec h hr hrs min mins hour hours minute minutes second seconds day days week weeks "
    "month months year years euro euros eur usd dollar dollars cents percent degrees uhr minuten tage heures jours minutos días минут дней руб".split()
)
NUMBER, NAME, UNIT = 1, 2, 3
#: Ways to read a text: as words; as characters; as characters of which a number is one unit, and so a slot.
WORDS, CHARS, NUMBERED = 0, 1, 2

_HTML_TAG = regex.compile(r"</?[A-Za-z][^<>]{0,80}>")
_BB_TAG = regex.compile(r"\[/?[A-Za-z]+(?:=[^\[\]]{0,80})?\]")
_INVISIBLE = regex.compile("[\u00AD\u200B-\u200D\u2060\uFEFF]")
#: The units of each way to read a text.
UNIT_OF = {WORDS: regex.compile(r"[\p{L}\p{M}\p{Nd}]+"), CHARS: regex.compile(r"[\p{L}\p{M}\p{Nd}]"), NUMBERED: regex.compile(r"[\p{L}\p{M}]|\p{Nd}+")}
_DIGIT = regex.compile(r"\p{Nd}")
_NO_SPACES = regex.compile(r"[\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str) -> str:
    """Entities decoded, tags removed, compatibility forms unified, invisible characters dropped; case is kept."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _HTML_TAG.sub("", text)
    if "[" in text:
        text = _BB_TAG.sub("", text)
    if text.isascii():
        return text
    return unicodedata.normalize("NFKC", _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)))


def fold(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text.casefold())


def is_name_like(word: str) -> bool:
    return word[0].isupper() and word[1:] != word[1:].upper()


def hashed(word: str) -> int:
    """A word as 64 bits, in the range of BIGINT."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def mixed(h: np.ndarray, x: np.ndarray | np.uint64) -> np.ndarray:
    """The hash of a sequence that goes on with ``x``."""
    h = (h + x) * _MULTIPLIER
    return h ^ (h >> np.uint64(29))


class WordSet:
    """Hashes of words, or a filter of them that may hold a few more."""

    def __init__(self, values: np.ndarray, bits: int = 0):
        self.values, self.bits = values, bits

    def __contains__(self, word: int) -> bool:
        if self.bits:
            return all(self.values[p >> 6] >> np.uint64(p & 63) & np.uint64(1) for p in ((word & (self.bits - 1)), (word >> 29 & (self.bits - 1))))
        at = int(np.searchsorted(self.values, word))
        return at < len(self.values) and int(self.values[at]) == word

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Which of many hashes are in a filter."""
        found = np.ones(len(h), bool)
        for p in (h & np.uint64(self.bits - 1), h >> np.uint64(29) & np.uint64(self.bits - 1)):
            found &= (self.values[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def filter_of(frame: DataFrame, column: str, n: int) -> WordSet:
    """A filter over a BIGINT column of ``n`` rows: 64 bits a row, at most ``MOST_BITS``; what the driver gets is as large at most."""
    bits = min(MOST_BITS, max(1 << 12, 1 << (64 * n).bit_length()))
    places = F.array(F.col(column).bitwiseAND(bits - 1), F.shiftright(column, 29).bitwiseAND(bits - 1))
    placed = frame.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("i"))
    table = placed.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    values = np.zeros(bits >> 6, np.uint64)
    values[table.column("i").to_numpy()] = table.column("b").to_numpy().view(np.uint64)
    return WordSet(values, bits)


def word_set(frame: DataFrame, column: str) -> WordSet:
    """The set of a column's values, or a filter of them if there are more than ``MOST_WORDS``."""
    n = frame.count()
    if n > MOST_WORDS:
        return filter_of(frame, column, n)
    return WordSet(np.sort(frame.select(column).toArrow().column(0).to_numpy().astype(np.int64)))


class Reader:
    """Reads texts in one of the ways into windows of templates; ``known`` and ``names`` hold the items' words and names."""

    def __init__(self, way: int, window: int, known: WordSet, names: WordSet):
        self.way, self.window, self.known, self.names = way, window, known, names
        self.least_plain = LEAST_PLAIN if way == WORDS else LEAST_PLAIN_CHARS
        self._forget()

    def _forget(self) -> None:
        """The words met so far: their places in two arrays of codes. Place 0 is no word."""
        self._places: dict[str, int] = {"": 0}
        self._codes = np.zeros((2, 1_024), np.uint64)

    def _learn(self, units: list[str]) -> None:
        fresh = [w for w in set(units) if w not in self._places]
        n = len(self._places)
        if n + len(fresh) > self._codes.shape[1]:
            self._codes = np.concatenate((self._codes, np.zeros((2, n + 2 * len(fresh)), np.uint64)), axis=1)
        for at, raw in enumerate(fresh, n):
            self._places[raw] = at
        if fresh:
            self._codes[:, n : n + len(fresh)] = np.array([self._code(w) for w in fresh], np.int64).astype(np.uint64).T

    def _code(self, raw: str) -> tuple[int, int]:
        """(code in templates, code of the word): its class for slots, 0 for a word that no item has and that fills no slot."""
        word = fold(raw)
        own = hashed(word)
        if _DIGIT.search(word):
            return NUMBER, own
        if self.way == WORDS:
            if own in self.names:
                return NAME, own
            if word in UNITS:
                return UNIT, own
        if own in self.known:
            return own, own
        return (NAME if self.way == WORDS and is_name_like(raw) else 0), own

    def places(self, text: str) -> list[int]:
        """The units of a normalised text, as places for ``codes``."""
        units = UNIT_OF[self.way].findall(text)
        try:
            return [self._places[u] for u in units]
        except KeyError:
            self._learn(units)
            return [self._places[u] for u in units]

    def codes(self, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Template codes and word codes; the places are not valid any more behind it."""
        at = np.array(places, np.int64)
        both = self._codes[0][at], self._codes[1][at]
        if len(self._places) > MOST_HELD:
            self._forget()
        return both

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Template codes and word codes of a normalised text."""
        return self.codes(self.places(text))

    def templates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, template hash) of the windows whose words all have a code."""
        n = len(codes) - self.window + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        gaps = np.concatenate(([0], np.cumsum(codes == 0)))
        at = np.flatnonzero(gaps[self.window :] == gaps[: -self.window])
        h = np.full(len(at), self.way + 1, np.uint64)
        for k in range(self.window):
            h = mixed(h, codes[at + k])
        return at, h

    def slots(self, at: np.ndarray, codes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of windows: the hash of their words, that of which slots hold the same word, and how many words are no slots."""
        exact, same = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        plain = np.zeros(len(at), np.int64)
        for first in range(0, len(at), 4_096):
            part = slice(first, first + 4_096)
            where = at[part, None] + np.arange(self.window)
            held, kinds = words[where], codes[where]
            slot = kinds <= UNIT
            plain[part] = self.window - slot.sum(axis=1)
            for k in range(self.window):
                exact[part] = mixed(exact[part], held[:, k])
                # the first place of the window that has the same word
                earlier = np.argmax(held[:, : k + 1] == held[:, k : k + 1], axis=1)
                same[part] = mixed(same[part], np.where(slot[:, k], earlier + 1, 0).astype(np.uint64))
        return exact, same, plain


def _ways(lang: str | None) -> tuple[int, ...]:
    return (CHARS, NUMBERED) if (lang or "").strip().lower()[:2] in CHAR_LANGS else (WORDS,)


def item_words(items: DataFrame) -> DataFrame:
    """(way, word, inner, lower) over all ``items`` (i, lang, t): each word without digits, whether it stands capitalised within a sentence, and whether in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[int, int], list[int]] = {}
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = normalise(text)
                for way in _ways(lang):
                    end = 0
                    for m in UNIT_OF[way].finditer(text):
                        gap, end = text[end : m.start()], m.end()
                        word = m.group()
                        if not _DIGIT.search(word):
                            held = seen.setdefault((way, hashed(fold(word))), [0, 0])
                            if not is_name_like(word):
                                held[1] = 1
                            elif gap and not any(c in gap for c in ".!?…:\"“”«»„‘’'\n"):
                                held[0] = 1
            cols = [[w for w, _ in seen], [h for _, h in seen], [v[0] for v in seen.values()], [v[1] for v in seen.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["way", "word", "inner", "lower"])

    rows = items.mapInArrow(run, "way int, word bigint, inner int, lower int")
    return rows.groupBy("way", "word").agg(F.max("inner").alias("inner"), F.max("lower").alias("lower"))


_WINDOWS = "h bigint, e bigint, c bigint"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def item_windows(items: DataFrame, readers: list[Reader]) -> DataFrame:
    """(h, e, c, item, enough, script, way): the windows of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = normalise(text)
                for way in _ways(lang):
                    reader = readers[way]
                    codes, words = reader.read(text)
                    at, h = reader.templates(codes)
                    if not len(at):
                        continue
                    exact, same, plain = reader.slots(at, codes, words)
                    units = UNIT_OF[way].findall(text) if way != WORDS else []
                    script = [int(way != WORDS and _NO_SPACES.search("".join(units[p : p + reader.window])) is not None) for p in at.tolist()]
                    enough = plain >= reader.least_plain if way != CHARS else np.zeros(len(at), bool)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(h), _signed(exact), _signed(same), pa.array([item] * len(at), pa.int64()), pa.array(enough), pa.array(script, pa.int32()), pa.array([way] * len(at), pa.int32())],
                        names=["h", "e", "c", "item", "enough", "script", "way"],
                    )

    return items.mapInArrow(run, f"{_WINDOWS}, item bigint, enough boolean, script int, way int").distinct()


def leaked_items(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", lang: str = "lang", passage: str = "passage",
    word_window: int = WORD_WINDOW, char_window: int = CHAR_WINDOW,
) -> DataFrame:
    """(key, item, exact): items whose passage shares a long enough window with a text.

    ``exact`` is 1 for the same words (characters for items in languages without
    spaces), 0 for a re-parameterised copy. Null texts and passages have none; a
    repeated text or item is reported once; texts of any length are read whole; an
    empty table gives no rows. The corpus is read in one map; broadcast are the items'
    words and a filter over their templates, both of bounded size. Windows that
    very many texts hold are spread over salts. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    given = items.select(F.col(item).cast("bigint").alias("i"), F.col(lang).cast("string").alias("l"), F.col(passage).alias("t")).filter("i is not null and t is not null")
    words = materialize(item_words(given), "item_words")
    sizes = {WORDS: word_window, CHARS: char_window, NUMBERED: char_window}
    sets = {}
    for way in sizes:
        own = words.filter(F.col("way") == way)
        sets[way] = (word_set(own, "word"), word_set(own.filter("inner > 0 and lower = 0"), "word") if way == WORDS else WordSet(np.empty(0, np.int64)))
    readers = [Reader(way, size, *sets[way]) for way, size in sizes.items()]
    windows = materialize(item_windows(given, readers), "item_windows")
    made = {r["way"]: (r["n"], r["script"]) for r in windows.groupBy("way").agg(F.count(F.lit(1)).alias("n"), F.min("script").alias("script")).collect()}
    passes = filter_of(windows, "h", sum(n for n, _ in made.values()))
    shipped = spark.sparkContext.broadcast(([r for r in readers if r.way in made], passes, {way: script > 0 for way, (_, script) in made.items()}))

    def met_in(reader: Reader, passes: WordSet, texts: list[tuple[int, str, bool]], needs_script: bool) -> Iterator[pa.RecordBatch]:
        """The windows of many texts that pass the filter; texts are read one behind the other, with a gap that no window spans."""
        flat: list[int] = []
        ends: list[int] = []
        keys: list[int] = []
        for n, (k, t, script) in enumerate(texts, 1):
            if script or not needs_script:
                flat += reader.places(t)
                flat.append(0)
                ends.append(len(flat))
                keys.append(k)
            if flat and (n == len(texts) or len(flat) > MOST_UNITS):
                codes, held = reader.codes(flat)
                at, h = reader.templates(codes)
                hit = passes.holds(h)
                at, h = at[hit], h[hit]
                exact, same, _ = reader.slots(at, codes, held)
                key = np.array(keys, np.int64)[np.searchsorted(ends, at, side="right")]
                yield pa.RecordBatch.from_arrays([pa.array(key), _signed(h), _signed(exact), _signed(same)], names=["k", "h", "e", "c"])
                flat, ends, keys = [], [], []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, passes, needs_script = shipped.value
        for batch in batches:
            texts = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = normalise(t)
                texts.append((k, t, not t.isascii() and _NO_SPACES.search(t) is not None))
            for reader in own:
                yield from met_in(reader, passes, texts, needs_script[reader.way])

    rows = spread(docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).filter("t is not null and k is not null"))
    met = materialize(rows.mapInArrow(run, f"k bigint, {_WINDOWS}"), "windows")
    theirs = windows.select("h", F.col("e").alias("_e"), F.col("c").alias("_c"), "item", "enough")
    pairs = salted_lookup(met, theirs, "h", hot_keys(met.select("h"), "h"), ["k"])
    equal = F.col("e") == F.col("_e")
    pairs = pairs.filter(equal | (F.col("enough") & (F.col("c") == F.col("_c"))))
    out = pairs.groupBy("k", "item").agg(F.max(equal.cast("bigint")).alias("exact"))
    return out.select(F.col("k").alias(key), F.col("item").alias(item), "exact")
