import random

import numpy as np

from pelorus.llm.leakage import leaks

WORDS = "amber basalt canoe desert engine forest glacier harbour island jungle kettle lantern meadow naturalist ocean pigment quarry river sapling terrace umbrella valley weaver yonder zephyr carried counted folded gathered polished".split()
LINE = "struct<line_no:int,x0:int,y0:int,x1:int,y1:int,conf:float,char_from:int,char_to:int>"
SCHEMA = f"doc_id long, text string, page_lines array<{LINE}>, page_w int, n_columns int, run string"


def page(doc_id, columns):
    """A page whose text reads across its columns."""
    lines, text, at = [], "", 0
    for k in range(max(map(len, columns))):
        for c, col in enumerate(columns):
            if k < len(col):
                lines.append((len(lines), 50 + 1000 * c, 100 + 30 * k, 900 + 1000 * c, 125 + 30 * k, 0.9, at, at + len(col[k])))
                text += col[k] + "\n"
                at = len(text)
    return (doc_id, text, lines, 1000 * len(columns), len(columns), "x")


def test_runs_damage_columns_and_decoys(spark):
    random.seed(6)
    sentence = lambda n: [random.choice(WORDS) for _ in range(n)]
    items = {k: sentence(60) for k in range(1, 6)}
    other = lambda n: [w + "x" for w in sentence(n)]
    wrap = lambda ws: [" ".join(ws[i : i + 6]) for i in range(0, len(ws), 6)]
    damaged = items[2][5:45]
    damaged[4], damaged[11] = "zzz", damaged[11][:3] + " " + damaged[11][3:]
    damaged[20] = damaged[20].upper().replace("O", "0") + ","
    advert = items[3][:15] + other(20) + items[3][15:32]
    broken = wrap(items[5][:30])
    broken[1], broken[2] = broken[1] + " " + broken[2][:2] + "-", broken[2][2:]
    docs = [
        page(1, [wrap(items[1][10:40])]), page(2, [wrap(other(30)), wrap(damaged)]), page(3, [wrap(other(10) + advert)]), page(4, [wrap(items[4][:12] + other(9) + items[4][30:44])]),
        page(5, [wrap(random.sample(items[1], 60))]), page(6, [broken]), (7, None, None, None, None, "x"), (8, "   ", [], 100, 1, "x"), (9, " ".join(items[1]), [], None, None, "x"), (1, *page(1, [wrap(items[1][10:40])])[1:]),
    ]
    d = spark.createDataFrame(docs, SCHEMA)
    i = spark.createDataFrame([(k, " ".join(v).capitalize() + ".", "x") for k, v in items.items()] + [(9, None, "x"), (None, "a b", "x"), (10, "", "x")], "item_id long, text string, doc_id string").drop("doc_id")
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks(d, i).collect())
    assert got == [(1, 1), (1, 1), (2, 2), (3, 3), (6, 5), (9, 1)]
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0


def test_changed_names_and_numbers_are_found_and_marked(spark):
    item = "The mayor of Tarbury paid 14 shillings for three geese at Elmstow, and the clerk of Tarbury counted 250 bushels before the bridge at Elmstow was opened by Captain Gorse in the presence of many friends."
    other = item.replace("Tarbury", "Quenwick").replace("Elmstow", "Dalport").replace("Gorse", "Penhale").replace("14", "9").replace("250", "37")
    mixed = item.replace("Tarbury", "Quenwick", 1).replace("Elmstow", "Dalport", 1).replace("Tarbury", "Dalport").replace("Elmstow", "Quenwick").replace("14", "9").replace("250", "9").replace("Gorse", "Penhale")
    noise = "On Monday a farmer sold his hay at Norwick. "
    rows = [(1, noise + other + " " + noise, [], None, None, "x"), (2, noise + item, [], None, None, "x"), (3, noise + mixed, [], None, None, "x"), (4, noise * 9, [], None, None, "x")]
    d, i = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in leaks(d, i).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {1: "reparameterised", 2: "verbatim"}
    # the two units and the captain's title stay
    assert got[1]["slots"] == 10 and got[1]["slots_agree"] == 3 and got[2]["slots"] == got[2]["slots_agree"]


def test_dense_stretch_of_a_thin_run_and_longest_common_subsequence():
    from pelorus.llm.leakage import densest, matched

    hits = [i for i in range(60) if i < 25 or i % 3 == 0]
    first, end = densest(60, hits, 20)
    assert first == 0 and end >= 25 and sum(h < end for h in hits) >= 0.87 * end
    assert densest(40, list(range(0, 40, 2)), 20) == (0, 0)
    a, b = np.array([1, 2, 3, 0, 4, 5]), np.array([9, 1, 3, 0, 5, 4])
    got = matched(a, b)
    assert len(got) == 3 and all(a[i] == b[j] > 0 for i, j in got) and got == sorted(got)
