"""Tokens, leaks and sentences."""

import pytest

from weftgraph.llm import sentences as module
from weftgraph.llm import tokenize
from weftgraph.llm import leaks
from weftgraph.llm.leaks import UNIT_OF, fold, leaked_items, normalise
from weftgraph.llm.sentences import sentence_ends, sentences

TEXTS = [
    None, "", " ", "\r\n\t", "Hello world, it's 3.14!", "<|endoftext|> plain", "a" * 5000, " " * 700 + "x", "日本語のテキスト。" * 90, "한국어" * 800,
    "é​­﻿", "👩‍👩‍👧‍👦🏽 :-)", "\x00\x07 ‮rtl", "don't we'll I'D",
]


def test_tokens(spark):
    library = pytest.importorskip("tokenizers")
    coder = library.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    coder.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS * 2)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in tokenize.encode_corpus(df).collect()}
    assert got == {i: coder.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(TEXTS * 2)}
    assert tokenize.encode_corpus(df.limit(0)).collect() == []


def test_trie_starts_anew(monkeypatch):
    monkeypatch.setattr(tokenize, "MOST_NODES", 50)
    vocabulary = tokenize.Vocabulary(tokenize.VOCABULARY)
    trie = tokenize.WordTrie(vocabulary)
    for words in ({"hello", " help"}, {"helium", " world" * 20}, {"hello"}):
        trie.encode(words)
        assert all(trie.words[w] == vocabulary.merge(w.encode()) for w in words)


def test_corpus_round_trip(spark, small):
    vocabulary = tokenize.Vocabulary(tokenize.VOCABULARY)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in tokenize.encode_corpus(docs).collect():
        assert b"".join(vocabulary.token[i] for i in r.ids).decode() == texts[r.doc_id]


# --- leaks -------------------------------------------------------------------

PASSAGE = "The green boat measured 33 jars of polished varnish near the east jetty while Nidras slept in Tellem for 5 days"


def test_normalise():
    assert fold(normalise("A<b>B</b>C [url=x]d[/url] &amp; ﬁ­x​y STRASSE Straße")) == "abc d & fixy strasse strasse"


def test_leaks(spark):
    words = PASSAGE.split()
    char_passage = "旧水泵藏起了裂开的罗盘码头管理员拍下了生锈的阀门暴风雨之后特乔图修好了温室的门虽然便宜的传感器卖掉了铜线"
    docs = [
        (1, "x\n> " + PASSAGE.upper().replace(" ", "\n> ")), (2, "so " + " ".join(words[3:15])), (3, " ".join(words[3:14])),
        (4, PASSAGE.replace("33", "41").replace("Nidras", "Quozan")), (5, PASSAGE.replace("green", "yellow").replace("varnish", "paint").replace("slept", "ran")),
        (6, None), (7, ""), (8, "和" + char_passage[2:42] + "。"), (9, char_passage[2:41]), (10, "，".join(char_passage)), (2, "so " + " ".join(words[3:15])),
        (11, "the <b>gr</b>een boat meas­ured 33 jars of pol​ished var[i]nish[/i] near the east j&#101;tty"), (12, "word " * 20_000 + PASSAGE),
    ]
    items = [(100, "en", PASSAGE), (101, "zh", char_passage), (102, "en", None), (103, "en", "too short"), (100, "en", PASSAGE), (104, None, " ".join(words[:13]))]
    df = spark.createDataFrame([(*d, "de", 0) for d in docs], "doc_id bigint, text string, lang string, k int")
    it = spark.createDataFrame(items, "item_id bigint, lang string, passage string")
    found = leaked_items(df, it).collect()
    exact = sorted((r.doc_id, r.item_id) for r in found if r.exact)
    assert exact == [(1, 100), (1, 104), (2, 100), (8, 101), (10, 101), (11, 100), (11, 104), (12, 100), (12, 104)]
    assert sorted((r.doc_id, r.item_id) for r in found if not r.exact) == [(4, 100), (4, 104)]
    assert leaked_items(df, it.limit(0)).collect() == [] and leaked_items(df.limit(0), it).collect() == []


def test_reparameterised(spark):
    texts = [PASSAGE.replace("33", "41"), PASSAGE.replace("jars", "cups")]
    docs = spark.createDataFrame([(i, t.split(" near")[0] + " near the east") for i, t in enumerate(texts)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "en", PASSAGE)], "item_id bigint, lang string, passage string")
    assert [tuple(r) for r in leaked_items(docs, items).collect()] == [(0, 1, 0)]


def test_reparameterised_characters(spark):
    """Numbers are slots in zh, ja and th too, whatever their length; other characters are not."""
    zh = "大约1.04巴的时候我的邻居找到了手册因为便宜的传感器找到了一盏黄灯笼退休的焊工在77分钟以后修好了温室的门"
    th = "ทีมซ่อนสมอ 35 ตัวตอน 4.30 น. แล้วกะขายน็อต 35 ตัวให้เพื่อนบ้านที่ท่าเรือ"
    docs = [
        (1, zh.replace("1.04", "2.22").replace("77", "108")), (2, zh), (3, zh.replace("手册", "图纸").replace("传感器", "水泵")),
        (4, th.replace("35", "7").replace("4.30", "12.15")), (5, th.replace("35", "7", 1)), (6, zh[:20].replace("1.04", "9.9")),
    ]
    items = spark.createDataFrame([(1, "zh", zh), (2, "th", th)], "item_id bigint, lang string, passage string")
    found = leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id, r.exact) for r in found) == [(1, 1, 0), (2, 1, 1), (4, 2, 0), (5, 2, 1)]


def test_filters_instead_of_words(spark, small, monkeypatch):
    """More words of items than are broadcast, and more words in a task than it remembers: the same leaks."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/eval_item.parquet")
    found = sorted(map(tuple, leaked_items(docs, items).collect()))
    assert found
    monkeypatch.setattr(leaks, "MOST_WORDS", 0)
    assert sorted(map(tuple, leaked_items(docs, items).collect())) == found
    reader = leaks.Reader(leaks.WORDS, 12, leaks.WordSet(leaks.np.array([leaks.hashed("boat")])), leaks.WordSet(leaks.np.empty(0, int)))
    monkeypatch.setattr(leaks, "MOST_HELD", 3)
    for text in ("a boat of 3 Men", "the Boat and Ann", "boat " + " ".join(f"x{k}" for k in range(3_000)) + " kg"):
        codes, words = reader.read(text)
        expected = [reader._code(w) for w in UNIT_OF[leaks.WORDS].findall(text)]
        assert [(int(a), int(b)) for a, b in zip(codes.view("int64"), words.view("int64"))] == expected


def test_recall_of_reparameterised_items(spark, small):
    """Every item with a number or a name in a window of enough plain words, re-parameterised, in every language; other words changed, it is none."""
    import random
    from collections import Counter

    import regex

    r = random.Random(2)
    rows = spark.read.parquet(f"{small}/eval_item.parquet").select("item_id", "lang", "passage").collect()
    docs, able = [], {}
    for row in rows:
        fresh: dict[str, str] = {}

        def other(m):
            return fresh.setdefault(m.group(), str(r.randrange(100, 999)) if "." not in m.group() else f"{r.randrange(100, 999)}.{r.randrange(10, 99)}")

        text = regex.sub(r"\d+(?:\.\d+)?", other, row.passage)
        if text != row.passage:
            docs.append((row.item_id, "Look: " + text + " Enough."))
            able[row.item_id] = row.lang
    found = {(d.doc_id, d.item_id): d.exact for d in leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(rows)).collect()}
    whole, hit = Counter(able.values()), Counter(able[i] for i in able if (i, i) in found)
    assert {lang: n for lang, n in whole.items() if hit[lang] < 0.9 * n} == {}
    assert set(whole) == {row.lang for row in rows}


def test_characters_as_entities(spark):
    """A post whose only characters of the script are numeric entities."""
    zh = "旧水泵藏起了裂开的罗盘码头管理员拍下了生锈的阀门暴风雨之后特乔图修好了温室的门"
    docs = spark.createDataFrame([(1, "so " + "".join(f"&#{ord(c)};" for c in zh)), (2, "so")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "zh", zh + "虽然便宜的传感器")], "item_id bigint, lang string, passage string")
    assert [(r.doc_id, r.exact) for r in leaked_items(docs, items, char_window=30).collect()] == [(1, 1)]


def test_leaks_brute_force(spark, small):
    import collections

    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/eval_item.parquet")
    grams = collections.defaultdict(set)
    def units(text, chars):
        return [fold(x) for x in UNIT_OF[leaks.CHARS if chars else leaks.WORDS].findall(normalise(text))]

    for r in items.collect():
        chars = r.lang in ("zh", "ja", "th")
        u, n = units(r.passage, chars), 40 if chars else 12
        for i in range(len(u) - n + 1):
            grams[chars, tuple(u[i : i + n])].add(r.item_id)
    expected = set()
    for r in docs.filter("text is not null").collect():
        for chars, n in ((False, 12), (True, 40)):
            u = units(r.text, chars)
            for i in range(len(u) - n + 1):
                expected |= {(r.doc_id, x) for x in grams.get((chars, tuple(u[i : i + n])), ())}
    assert {(r.doc_id, r.item_id) for r in leaked_items(docs, items).collect() if r.exact} == expected


# --- sentences ---------------------------------------------------------------

CASES = [
    "Dr. Wyha came at 6 a.m.|| My pump broke, e.g. the blue one.|| bright rig won.",
    "Well... the rig sat.|| It broke...|| The end.|| Was it 1.35 bar (why though?) near the gate?!|| Yes",
    '"Was it 1.35?" asked Uljor.|| Griwy said, "My bell rang."|| The end.',
    "“Our club left?” they wondered.|| “It rained.”|| The end. 🙃|| Next one. :-)|| Last",
    "«Было 6,59?» — спросил Рас.|| Трубы, скобы и т. д.|| Половина ждёт напр. синий.",
    "„War es 0,75?“ fragte Olha.|| Am 3. Mai kam z. B. Tus (vgl. Abb. 48).|| Der Rest",
    "Il y avait 3 boulons ?|| « Un ami partait ! » criait Bex.|| Fin p. ex. le bleu.",
    "¡Hola!|| ¿Vino el Sr. Fen?|| «¡Sí!», gritó Jor.|| Fin.",
    "格佩洛拍下了铜线。||我的邻居走了！||“夜班来了！”芬瓦喊道。||特格说：“小船走了。”||完了",
    "「村は割れた！」とジョが叫んだ。||（緑の舟。）||終わり",
    "ทีมซ่อนสมอตอน 4.30 น.|| กะขายน็อต 35 ตัวต่าง ๆ มาก|| จบ",
    "हमारा क्लब।|| “हरी नाव!” फेन चिल्लाया।|| अंत (पृ. 81 देखें)।",
    "قال برفا: «القارب وجد.»|| يوم الاثنين نظف؟|| مع د. فابل.",
    "thermostat broke.||The apprentice left at node2.example using config.ini.|| See www.a.invalid/x.html.|| End",
    "On 2018-09-02, pel-x wrote:||\n> One line\n> goes on.|| Two.||\n>> Deeper||\n\nBack to it||\n\n-- \nSent. From here.\nMe",
    "List:||\n\n1. First item||\n2. Second e.g. one.||\n\n[code]\na. B\n[/code]||\n\n[quote=x]\nIn it.||\n[/quote]\nAfter",
    'He left.</b>|| <b>She "p.m." stayed.|| It was No. 86.|| Then rain [i]fell[/i].',
    "We cut hoses, clips, etc.|| (Half paint.)|| Rope at Ultus Ltd.|| Nobody came from the Tus! shop today.",
]


@pytest.mark.parametrize("case", CASES)
def test_sentences(case):
    text, ends = "", []
    for part in case.split("||"):
        text += part
        ends.append(len(text.rstrip()))
    assert sentence_ends(text) == sorted(set(ends))


@pytest.mark.parametrize(
    "case",
    [
        "He said no.|| Then he left.|| There is no time and no boat.",
        "Creo que no.|| Pero hoy no hay nada y no importa.",
        "Отдал им.|| Потом ушёл.|| Мы с им же и с им самим.",
        "Dr. Wyha came.|| Later Dr Fen and Dr Bol met Dr. Uld in aisle no. 5 again.",
    ],
)
def test_document_before_lists(case):
    """A listed word that the document uses without a stop ends its sentence."""
    test_sentences(case)


@pytest.mark.parametrize(
    "case",
    [
        "The brig. 3 came.|| See the brig. and brig. 5 there.|| A brig. and then.",
        "Acme Inc. Chairman Fen spoke.|| We met Chairman Bol.|| He sold to Acme Inc.|| They were glad and they left.",
    ],
)
def test_document_evidence(case):
    """An abbreviation that no list has, of over two letters and with a vowel; a name behind a final abbreviation, and a common word."""
    test_sentences(case)


@pytest.mark.parametrize(
    "case",
    [
        "He sold his art.|| The art was good.",
        "I said no.|| The no came late.",
        "He said no.|| She went home.",
        "like ed.|| The ed was fine.",
        "Gen. Smith came.|| Capt. Roy left.",
        "Dat is drs. Jansen.|| Er zijn bijv. Appels.",
        "Det kan t.ex. Anna.|| To jest inż. Nowak i m.in. Ola.",
        "Τι κάνεις;|| Καλά είμαι.|| Ναι",
        "Բարեւ։|| Ինչպես ես։",
        "ሰላም።|| እንዴት ነህ፧|| ደህና",
        "یہ کشتی ہے۔|| وہ گھر ہے۔",
        "The PelMk.II broke.||So it was.",
        "Abschreibungsgesellsch. 3 kam.|| Die Abschreibungsgesellsch. und Abschreibungsgesellsch. 5 auch.|| Ende.",
    ],
)
def test_scripts_and_single_documents(case):
    """Ordinary words that lists hold, terminators of further scripts, abbreviations of any length, a number behind a stop."""
    test_sentences(case)


def test_corpus_tells_names_with_marks_and_speakers(spark):
    """A word behind a name's mark and a speaker's verb are known from the corpus, in capitals too."""
    rows = [(i, f"We saw the Pel{'abcdefgh'[i % 8]}! depot. “Was it 3?” mumbled Fen.") for i in range(20)]
    rows += [(90, "AT OUR OLD PELX! DEPOT. “WAS IT 4?” MUMBLED FEN. END.")]
    ends = {}
    for r in sentences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        ends.setdefault(r.doc_id, []).append(r.end_pos)
    assert {len(v) for k, v in ends.items() if k < 90} == {2}
    assert len(ends[90]) == 3


def test_linear_time():
    """Sixteen times the text takes about sixteen times as long, ambiguous stops, quotes and many words with stops included."""
    import time

    def took(n):
        text = " ".join(f'“w{k % 7}, see art. {k}.” A.b.c. Wor{"abcdefghij"[k % 10]}d{k}x. It\'s "no. {k}" at p.m. Nobody (vgl. {k}' for k in range(n))
        begun = time.process_time()
        sentence_ends(text)
        return time.process_time() - begun

    took(200)
    assert took(8_000) < 60 * min(took(500) for _ in range(3))


def test_join_of_words(spark, small, monkeypatch):
    """More words than are broadcast: joined to the documents, with the same ends."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = [(i, f"It shows quux. {i} here.") for i in range(40)] + [(99, "It shows quux. Nine here."), (99, "It shows quux. Nine here."), (None, "No. 5 art. Nine."), (97, None)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id bigint, text string"))
    broadcast = sorted(sentences(docs).collect(), key=str)
    monkeypatch.setattr(module, "HELD_WORDS", 0)
    assert sorted(sentences(docs).collect(), key=str) == broadcast


def test_evidence_does_not_fade(spark):
    """A word with five stops keeps its kind however many stops the corpus has."""
    columns = ", ".join(f"{k} bigint" for k in module.KINDS)
    rows = [("quux", 0, 6, 0, 0, 0, 0, 0, 0), ("boats", 9, 0, 5_000_000, 5_000_000, 0, 9, 0, 0)]
    assert {r.word: r.kind for r in module.lexicon(spark.createDataFrame(rows, f"word string, {columns}")).collect()} == {"quux": "open"}


def test_corpus_before_lists(spark):
    """``no`` and ``art`` are ordinary words of this corpus; ``quux`` is an abbreviation that no list has."""
    rows = [(i, f"There is no boat and no art {'of ours' * (i % 2)} today. It shows quux. {i} here.") for i in range(40)]
    rows += [(98, "He said no. Then he left. We like art. Nobody came."), (99, "It shows quux. Nine here.")]
    ends = {}
    for r in sentences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        ends.setdefault(r.doc_id, []).append(r.end_pos)
    assert sorted(ends[98]) == [11, 25, 38, 51]
    assert len(ends[3]) == 2


def test_blank_texts():
    assert [sentence_ends(t) for t in (None, "", " \n\t", "> \n>")] == [[], [], [], []]
    assert sentence_ends("x" * 100_000) == [100_000]


def test_sentences_with_corpus(spark):
    texts = [(i, f"Lo dice el art. {i} del libro. Otro caso fue el art. Nueve.") for i in range(40)] + [(99, None), (98, ""), (97, "Segun el art. Nueve. Fin."), (97, "Segun el art. Nueve. Fin.")]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id bigint, text string, end_pos string")
    rows = sentences(df).collect()
    assert sorted(r.end_pos for r in rows if r.doc_id == 97) == [20, 20, 25, 25]
    assert {r.doc_id for r in rows} == {*range(40), 97}
    assert sentences(df.limit(0)).collect() == []


def test_positions_are_valid(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    for text in docs.values():
        ends = sentence_ends(text)
        assert ends == sorted(set(ends))
        assert all(not text[e - 1].isspace() for e in ends)
        assert bool(ends) == bool(text and text.strip())
