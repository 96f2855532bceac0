from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from caravel.llm import decontaminate as d
from caravel.llm import queries

QUESTION = "A shop sells 12 pears for 3 dollars and then Anna Berg buys 40 kg of flour from the mill so how many bags of 5 kg does Anna Berg need at home"
ITEMS = [
    (1, QUESTION), (2, "Every evening the old clock above the narrow door strikes seven and nobody in the house looks up from supper"), (3, "too short to tell"), (4, None), (5, ""),
    (6, "7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24"),
]
CLEAN = "nothing of this has been seen before and the words go on in an order of their own until the line ends somewhere"
DOCS = [
    (10, "Before. " + QUESTION + " After that more text."),
    (11, CLEAN + " a shop sells 99 pears for 8 dollars and then Lena Ode buys 71 kg of flour from the mill so how many bags of 2 kg does Lena Ode need at home"),
    (12, CLEAN + " a shop sells 99 pears for 8 dollars and then Lena Ode buys 71 kg of flour from the mill so how many bags of 2 kg does Olga Ode need at home"),
    (13, CLEAN), (14, None), (15, ""), (None, QUESTION), (16, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18"),
    (17, "x " * 500 + ITEMS[1][1].upper() + " y" * 500), (18, QUESTION), (18, CLEAN), (19, "every evening the old clock above the narrow"),
]


def found(docs, items, **options):
    return {(r["doc_id"], r["item_id"]): r for r in d.contaminated(docs, items, **options).collect()}


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string").selectExpr("*", "'x' AS key", "1 AS item", "2 AS window")


def test_copies_and_questions_with_other_values(docs_of, items):
    got = found(docs_of(*DOCS, clashing=True), items)
    assert set(got) == {(10, 1), (11, 1), (17, 2), (18, 1)}
    assert got[(10, 1)]["changed_slots"] == 0 and got[(10, 1)]["n_slots"] > 6
    assert got[(11, 1)]["changed_slots"] > 4  # 12: the buyer's name changes half way, so the slots contradict each other


SHORT = [
    (1, "What is the capital of the old northern kingdom?"), (2, "Name three rivers"), (3, "Anna, Berta and Carl Olsen sold 12 of 40 boats to Dora."),
    (4, "3 + 4 = ?"), (5, "12 17 23 31 45 52 68 71 89 94"), (6, "Anna Berg, Carl Dahl, Eva Falk, Gro Holm"), (7, "Which of the two twins Ada Lind and Mia Lind was born in 1950 then?"),
]


def test_short_items_in_mid_sentence_and_in_other_case(spark, docs_of):
    items = spark.createDataFrame(SHORT, "item_id bigint, text string")
    forms = {10: "see below {} and more", 20: "see below\n{}", 30: "{}"}
    docs = [(100 * i + n, form.format(text)) for i, text in SHORT for n, form in forms.items()]
    docs += [(100 * i + n, f"and then {text}, he said") for i, t in SHORT for n, text in ((40, t.lower()), (50, t.upper()))]
    apart = [
        (1, "what is the capital of the old southern kingdom"), (2, "name three lakes"), (3, "3 - 4 = ?"), (4, "12 17 23 31 45 52 68 71 89 95"),
        (5, "Anna Berg, Carl Dahl, Eva Falk"), (6, "rivers three name"),
    ]
    assert set(found(docs_of(*docs, *apart), items)) == {(d, d // 100) for d, _ in docs}


def test_first_word_is_alike_where_a_question_has_other_values(spark, docs_of):
    items = spark.createDataFrame([(1, "Who sold the 12 old boats of the northern harbour to a trader")], "item_id bigint, text string")
    assert set(found(docs_of((5, "see below Who sold the 90 old boats of the northern harbour to a trader")), items)) == {(5, 1)}


def test_one_changed_value_does_not_hide_a_passage(docs_of, items):
    long = QUESTION + " and how many coins of 2 euros will be left in the small red purse when the day at the market is over"
    once = long.replace("of 5 kg does Anna Berg", "of 5 kg does Olga Berg")
    got = found(docs_of((1, CLEAN + " " + once)), items.sparkSession.createDataFrame([(1, long)], "item_id bigint, text string"))
    assert set(got) == {(1, 1)}


def test_values_may_become_equal_and_carry_other_punctuation(docs_of, items):
    docs = [
        (1, QUESTION.replace("12", "8").replace("40", "8").replace("Anna Berg", "Lena Ode")),
        (2, QUESTION.replace("12", "9").replace("Anna Berg need", "'Lena Ode', need").replace("Anna Berg", "Lena Ode")),
    ]
    assert set(found(docs_of(*docs), items)) == {(1, 1), (2, 1)}


def test_template_tokens_stand_for_words_one_for_one(docs_of):
    (row,) = d.tokens(docs_of((1, "He paid  $3.50 for 20kg,\nthen Mary-Ann O’Neil left. Then 5 % <b> rest 1,000.5!")), "doc_id", "text").collect()
    assert len(row["words"]) == len(row["tokens"])
    assert row["tokens"] == "he paid <0> for <0><1> then <2> <2> left then <0> <1> b rest <0>".split()


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 8])
def test_window_hashes_depend_on_their_tokens_only(spark, size):
    tokens = ["a", "b", "c", "a", "b", "c", "a", "b", "c", "d"]
    frame = spark.createDataFrame([(1, tokens), (2, tokens[:size]), (3, tokens[: size - 1])], "key bigint, tokens array<string>")
    rows = d.windows(frame, size).collect()
    by_hash = {}
    for r in rows:
        by_hash.setdefault(r["window"], set()).add(tuple(tokens[r["at"] : r["at"] + size]))
    assert all(len(texts) == 1 for texts in by_hash.values())
    assert len(by_hash) == len({tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)})
    assert sum(r["key"] == 1 for r in rows) == len(tokens) - size + 1 and sum(r["key"] == 2 for r in rows) == 1
    assert not any(r["key"] == 3 for r in rows)


def test_empty_tables(docs_of, items):
    assert found(docs_of(*DOCS).where("false"), items) == {}
    assert found(docs_of(*DOCS), items.where("false")) == {}


def test_only_native_functions_run(docs_of, items, capsys):
    d.contaminated(docs_of(*DOCS), items).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def templates(text):
    """Words and template tokens of a text, by Python's own means."""
    words = re.sub(r"[<> \t\n\x0b\f\r]+", " ", text or "").strip(" ").split(" ")
    out = []
    for i, w in enumerate(words):
        t = re.sub(r"[0-9]+(?:[.,:/-][0-9]+)*", "<0>", w)
        before = words[i - 1][-1:] if i else "."
        before = ">" if before.isdigit() else before
        if before not in ".!?:; " and t[:1].isupper() and not t[1:2].isupper():
            t = re.sub(r"^[^\W\d_](?:[^\W\d_]|['’-])*", "<2>", t)
        out.append(t.lower())
    units = "|".join(sorted(map(re.escape, d.UNITS), key=len, reverse=True))
    joined = re.sub(rf"(<0> ?)(?:{units})(?![^\W_])", r"\1<1>", " ".join(out))
    return words, re.sub(r"[!-/:;=?@\[-`{-~«»“”‘’„–—…]+", "", joined).split(" ")


def test_query_equals_brute_force(spark, small):
    """Every window of every document against every window of every item."""
    items = {r["item_id"]: templates(r["text"]) for r in small("benchmark").collect()}
    windows = {}
    for item, (_, ts) in items.items():
        for i in range(len(ts) - d.SIZE + 1):
            w = tuple(ts[i : i + d.SIZE])
            if sum(bool(t) and "<" not in t for t in w) >= d.LITERALS:
                windows.setdefault(w, set()).add((item, i))
    total = {}
    for places in windows.values():
        for item, _ in places:
            total[item] = total.get(item, 0) + 0
    for item in items:
        total[item] = sum(1 for places in windows.values() for x in places if x[0] == item)
    want = set()
    for r in small("documents").collect():
        words, ts = templates(r["text"])
        spans = {}
        for i in range(len(ts) - d.SIZE + 1):
            for item, j in windows.get(tuple(ts[i : i + d.SIZE]), ()):
                spans.setdefault((item, i - j), set()).add(j)
        for (item, offset), places in spans.items():
            if len(places) >= min(d.LEAST, total[item]):
                slots = [j for j in range(min(places), max(places) + d.SIZE) if "<" in items[item][1][j]]
                pairs = {(items[item][0][j].lower(), words[j + offset].lower() if 0 <= j + offset < len(words) else None) for j in slots}
                if len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs):
                    want.add((r["doc_id"], item))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and len(want) >= 3


def test_patterns_pass_over_what_stays_and_give_the_same_texts(spark):
    assert not re.search(d.UNEVEN, "a b") and set(d.SIGN_LIST) == {c for c in map(chr, range(0x3000)) if re.fullmatch(d.SIGNS, c)}
    draw = random.Random(7)
    signs = ["a", "b ", " ", "  ", "<", "> ", "\t", "\n", "\x0b", "\r\n", ".", ",", "(", "\\", "’", "…", "7", "ß", "Ω", "\u00a0", "😀", "12 km", "X"]
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 30))) for _ in range(2000)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    old = F.trim(F.regexp_replace("text", d.BLANKS, " "))
    assert frame.where(~d.word_text(F.col("text")).eqNullSafe(old)).isEmpty()
    assert frame.where(~F.translate("text", d.SIGN_LIST, "").eqNullSafe(F.regexp_replace("text", d.SIGNS, ""))).isEmpty()
