import random

from plexaform.llm.leakage import leaks, plain_words, without_leaks

RND = random.Random(9)
VOCAB = [f"{a}{b}" for a in ("lum", "tor", "ves", "kan", "dri", "pol", "mib", "sag") for b in ("ar", "en", "is", "ok", "ut", "ey", "al")]


def words(n):
    return [RND.choice(VOCAB) for _ in range(n)]


ITEM = words(70)
OTHER = words(70)
NOISE = words(300)


def text(*parts):
    return " ".join(x for p in parts for x in p)


def edited(ws, every=9):
    out = []
    for i, w in enumerate(ws):
        if i % every == every - 1:
            out += {0: [], 1: [w, "extra"], 2: ["changed"]}[i // every % 3]
        else:
            out.append(w)
    return out


CASES = {
    1: (text(NOISE[:50], ITEM, NOISE[50:90]), True),
    2: (text(NOISE[:50], ITEM[20:50]), True),
    3: (text(NOISE[:50], ITEM[20:32], NOISE[:40]), False),
    4: (text(ITEM[:15], NOISE[:20], ITEM[15:32]), True),
    5: (text(edited(ITEM)).upper(), True),
    6: ("// " + "\n// ".join(text(ITEM[i:i + 6]) for i in range(0, 60, 6)), True),
    7: ("<p>" + "&nbsp;".join(ITEM) + "</p>", True),
    8: (" ".join(w[:2] + "​" + w[2:] for w in ITEM).replace("a", "а").replace("e", "е"), True),
    9: (", ".join(w.capitalize() + "!" for w in ITEM[:40]), True),
    10: (text(list(reversed(ITEM))), False),
    11: (text(NOISE), False),
    12: ("", False),
    13: (None, False),
    14: (text(NOISE) * 200 + " " + text(ITEM), True),
    15: (text(ITEM[:10], NOISE[:10], ITEM[10:20], NOISE[10:20]), False),
}


def found(spark, rows, items):
    d = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame(items, "item_id bigint, text string, doc_id int")
    return leaks(d, "doc_id", "text", e, "item_id", "text")


def test_cases(spark):
    rows = [(i, t, "clash") for i, (t, _) in CASES.items()] + [(1, CASES[1][0], "again"), (None, CASES[1][0], "x")]
    items = [(7, text(ITEM), 0), (7, text(ITEM), 0), (8, text(OTHER), 0), (9, None, 0), (10, "", 0), (11, "two words", 0)]
    got = found(spark, rows, items)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(i, 7) for i, (_, y) in CASES.items() if y]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    assert {r["doc_id"] for r in without_leaks(d, "doc_id", got).collect()} == {i for i, (_, y) in CASES.items() if not y} | {None}


def test_blocks_of_items(spark, monkeypatch):
    from plexaform.llm import leakage

    monkeypatch.setattr(leakage, "BLOCK_WORDS", 80)
    got = found(spark, [(1, text(ITEM, NOISE[:30], OTHER), "")], [(7, text(ITEM), 0), (8, text(OTHER), 0)])
    assert {r["item_id"] for r in got.collect()} == {7, 8}


def test_empty(spark):
    assert found(spark, [], [(7, text(ITEM), 0)]).count() == 0
    assert found(spark, [(1, text(ITEM), "")], []).count() == 0


def test_words():
    assert plain_words("Out-of-order, src/a.c:8!") == [b"outoforder", b"srcac8"]
    assert plain_words("line-\n// wrapped") == [b"linewrapped"]
    assert plain_words("Größe, señor; «слово» 東京!") == ["große".encode(), b"senor", plain_words("слово")[0], "東京".encode()]
    assert plain_words("") == [] and plain_words("\x00 \u200b —") == []


def test_two_close_pieces(spark):
    """Two intact pieces with 4 to 8 document words between them, or with as many item words skipped, are two pieces."""
    rows = [(n, text(NOISE[:50], ITEM[:14], NOISE[60:60 + n], ITEM[14:28], NOISE[90:120]), "") for n in range(4, 9)]
    rows += [(10 + n, text(NOISE[:50], ITEM[:14], ITEM[14 + n:28 + n], NOISE[90:120]), "") for n in range(4, 9)]
    rows += [(20 + n, text(NOISE[:50], ITEM[:14], NOISE[60:60 + n], ITEM[20:34], NOISE[90:120]), "") for n in range(4, 9)]
    slips = ITEM[:7] + ["changed"] + ITEM[8:20], ITEM[20:32] + ["changed"] + ITEM[33:40]
    rows += [(30 + n, text(slips[0], NOISE[60:60 + n], slips[1]), "") for n in range(4, 9)]
    # a second gap is not parted again, and 22 words stay too few
    rows += [(41, text(ITEM[:10], NOISE[:8], ITEM[10:20], NOISE[20:28], ITEM[20:30]), ""), (42, text(NOISE[:50], ITEM[:11], NOISE[60:66], ITEM[11:22]), "")]
    got = found(spark, rows, [(7, text(ITEM), 0)])
    assert {r["doc_id"] for r in got.collect()} == {b + n for b in (0, 10, 20, 30) for n in range(4, 9)}
