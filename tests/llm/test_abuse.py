import os
import random

import pytest

from quernstone.llm import abuse, grammar

BAD = [
    "you are a complete idiot and everyone here knows it", "what a bunch of lying d.i.c.k.h.e.a.ds running this place", "shut up, you pathetic p-i-e-c-e- -o-f- -s-h-i-t.", "only a $cumb@g would defend this board",
    "you are a complete scccccumbag", "shut up, you pathetic r****d", "ONLY A B.A.S.T.A.R.D WOULD DEFEND THIS BOARD", "І knоw whеrе yоu livе аnd I will brеаk yоur lеgs", "do the world a f@v0r and jump off the roof",
    "migrants are vermin and should be driven out", "w0m3n do not d3s3rv3 to live among decent people", "send me nudes, I will lick you 3v3rywh3r3", "你就是个废物，别在这里丢人", "只有王*蛋才会替他们说话", "你怎么还不去４吧",
    "闭嘴吧，傻 逼", "女人天生就是劣等人，不配活着", "裸.聊约*炮加我", "楼上的chu生脑子被驴踢了", "你們全是腦殘", "du bist ein elender A-r-s-c-h-l-o-c-h", "ich finde dich und schlage dich tot", "tu n’es qu’un salaud, ferme ta gueule",
    "les étrangers sont de la vermine, qu’on les chasse tous", "ты просто м***к, заткнись уже", "Я ТЕБЯ НАЙДУ И УБЬЮ, ГОТОВЬСЯ", "в правлении одни уроды и воры", "приезжие — паразиты, гнать их всех отсюда",
    "Ordinary text about orders. " * 50 + "kill yourself. " + "More ordinary text. " * 50,
]
FINE = [
    "Bastard files, cock valves and screw fasteners are sold in Eastern Europe.", "Our policy prohibits sexual harassment, threats and abusive language at work.", "The hate-speech and nudity filter blocked 9 posts a day.",
    "Rodent and vermin control was outsourced for 9 sites.", "A dumb terminal replaced the master and slave controllers.", "The sex ratio and weight of 402 pigs were recorded at the farm.", "Market penetration reached 9% despite violent price swings",
    "清洗工艺消除了去死角残留。", "狗年限定包装和猪肉制品渠道已下架", "裸机价格不含税，裸眼检测已取消", "公司制定了反性骚扰与反歧视制度，并设立举报热线", "新型杀菌设备可杀死39.5%以上的细菌", "内容审核平台每日拦截仇恨言论与色情信息约20条",
    "Die Müllverbrennung und die Schweinezucht liefen ohne Störung", "Le traitement des ordures et des porcs a coûté 9 milliers", "Переработка мусора и свиноводство дали 9 % выручки", "Poor service and a late reply, I am disappointed 😕.",
    "管理层的说明令人失望，希望改进披露。", "Complaint: the manager was fined because he wrote “you are an idiot” in a mail.", "xkCd5u1t9pLq0zW8aB3", "",
]


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    assert max(abuse.score_texts([text])[0].values(), default=0) >= abuse.THRESHOLD, abuse.reveal([text])


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert max(abuse.score_texts([text])[0].values(), default=0) < abuse.THRESHOLD, abuse.reveal([text])


@pytest.mark.parametrize(("text", "category"), [("你是猪", "insult"), ("我要揍你", "threat")])
def test_words_of_one_character(text, category):
    assert abuse.score_texts([text])[0].get(category, 0) >= abuse.THRESHOLD


def _rates(name):
    """(precision, recall) over a file of labelled sentences."""
    path = os.path.join(os.path.dirname(__file__), name)
    rows = [line.rstrip("\n").split("|", 3) for line in open(path, encoding="utf-8") if not line.startswith("#")]
    hits = [max(w.values(), default=0) >= abuse.THRESHOLD for w in abuse.score_texts([r[3] for r in rows])]
    true = sum(h for h, r in zip(hits, rows) if r[0] == "1")
    return true / max(1, sum(hits)), true / sum(r[0] == "1" for r in rows)


@pytest.mark.parametrize(
    ("name", "precision", "recall"),
    # the first three were in view while the grammar was made or widened; the last was run once
    [("heldout_sentences.txt", 0.97, 0.97), ("fresh_sentences.txt", 0.95, 0.9), ("second_sentences.txt", 0.95, 0.9), ("blind_sentences.txt", 0.9, 0.65)],
)
def test_sentences(name, precision, recall):
    got = _rates(name)
    assert got[0] >= precision and got[1] >= recall, got


@pytest.mark.parametrize(("plain", "governed"), [
    ("You are an idiot.", "You are not an idiot."), ("I will kill you.", "He was jailed for saying that I will kill you."), ("Foreigners are vermin.", "It is wrong to say that foreigners are vermin."),
    ("Du bist ein Idiot.", "Niemand sagt, dass du ein Idiot bist."), ("Tu es un crétin.", "Personne ne dit que tu es un crétin."), ("Ты идиот.", "Никто не говорит, что ты идиот."), ("你是白痴。", "没有人说你是白痴。"),
    ("You are an idiot.", "“You are an idiot,” said the villain in the film."),
])
def test_denials_and_reports_lower_the_weight(plain, governed):
    best = lambda t: max(abuse.score_texts([t])[0].values(), default=0)
    assert best(plain) >= abuse.THRESHOLD > best(governed)


def test_a_denial_ends_with_its_clause():
    for t in ("I do not agree, you idiot.", "That is not true but you are an idiot.", "She never came. You are an idiot."):
        assert abuse.score_texts([t])[0]["insult"] >= abuse.THRESHOLD


def test_every_path_needs_content():
    """So that a text without content words can be skipped."""
    for _, _, path in grammar.PATHS:
        assert any(n <= grammar.CONTENT for n in grammar.needs(path)), path
    known = {n for names in grammar.classes().values() for n in names} | {"MASKED"}
    assert {n for _, _, path in grammar.PATHS for names in grammar.needs(path) for n in names} <= known | {"COMMA"}


def _walk(items, s, at, sym):
    """Can the rest of a path be walked from a place? By trying every way."""
    if not items:
        return True
    item, rest = items[0], items[1:]
    kinds = [sym.kinds.get(c, frozenset({c})) for c in s]
    if item[0] in "~-,." and item[1:].isdigit():
        bad = {"~": set(".|,:") | {"BUT"}, "-": set(".|,:") | {"LINK", "CALL", "BUT"}, ",": set(".|"), ".": {"|"}}[item[0]]
        for n in range(int(item[1:]) + 1):
            if at + n > len(s) or any(kinds[i] & bad for i in range(at, at + n)):
                return False
            if _walk(rest, s, at + n, sym):
                return True
        return False
    if item == "START":
        return (at == 0 or bool(kinds[at - 1] & set(".|,:q"))) and _walk(rest, s, at, sym)
    names, mark = set(item.rstrip("?+").split("|")), item[len(item.rstrip("?+")) :]
    if "END" in names and (at == len(s) or kinds[at] & (set(".|,:q") | {"BUT"})) and _walk(rest, s, at, sym):
        return True
    names = {"," if n == "COMMA" else n for n in names - {"END"}}
    if mark == "?" and _walk(rest, s, at, sym):
        return True
    for n in range(1, 4 if mark == "+" else 2):
        if at + n > len(s) or not kinds[at + n - 1] & names:
            return False
        if _walk(rest, s, at + n, sym):
            return True
    return False


def test_paths_against_brute_force():
    r = random.Random(3)
    sym = abuse.lexical().symbols
    for _, _, path in grammar.PATHS:
        items = path.rstrip("* ").split()
        pattern = sym.compile(path.rstrip("* "))
        near = [c for n in grammar.needs(path) for c in sym.chars("|".join(n))[:4]] + list(",.oq:") + list(sym.chars("BUT")[:1]) + list(sym.chars("LINK")[:1])
        for _ in range(60):
            s = "".join(r.choice(near) for _ in range(r.randint(1, 9)))
            assert (pattern.search(s) is not None) == any(_walk(items, s, at, sym) for at in range(len(s) + 1)), (path, s)


def test_batches_do_not_matter():
    together = abuse.score_texts(BAD + [None] + FINE)
    assert together == [abuse.score_texts([t])[0] for t in BAD + [None] + FINE]


def test_frames(spark):
    df = spark.createDataFrame([(1, BAD[0], "a", 3.0), (1, BAD[0], "a", 3.0), (2, None, "a", 3.0), (3, "", None, 3.0), (4, FINE[0], None, 3.0), (5, "x " * 100_000 + BAD[1], "a", 3.0)], "doc_id bigint, text string, source string, score double")
    scored = abuse.score_column(df.drop("score"), "doc_id", "text", "source")
    got = {r.doc_id: (r.score, r.category) for r in scored.collect()}
    assert got[1][1] == "insult" and got[2] == got[3] == (0.0, None) and got[5][0] >= abuse.THRESHOLD
    assert sorted((r.source or "", r.texts, r.unwelcome) for r in abuse.rates(scored, "source").collect()) == [("", 2, 0), ("a", 4, 3)]
    assert abuse.score_column(df.limit(0), "doc_id", "text").count() == 0


def test_labelled_documents(spark, sf):
    """Against the labels, some of which are wrong: most stated cases are found, and few others."""
    d = f"{sf}/../sf0.1"
    labels = spark.read.parquet(f"{d}/content_labels.parquet").groupBy("doc_id").agg({"label": "min", "*": "count"}).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    scores = abuse.score_texts([texts[r.doc_id] for r in labels])
    found = [max(s.values(), default=0) >= abuse.THRESHOLD for s in scores]
    stated = [r["min(label)"] == 1 for r in labels]
    assert sum(f and s for f, s in zip(found, stated)) > 0.8 * sum(stated)
    assert sum(f and not s for f, s in zip(found, stated)) < 0.02 * len(labels)


def test_very_long_texts_take_linear_time():
    import time

    began = time.perf_counter()
    got = abuse.score_texts(["you idiot and not a fool you said " * 60_000, "women vermin " * 50_000 + "rodent and vermin control " * 50_000, "a.b.c.d " * 100_000])
    assert time.perf_counter() - began < 20
    assert got[0]["insult"] >= abuse.THRESHOLD and got[1]["hate"] >= abuse.THRESHOLD and not got[2]
