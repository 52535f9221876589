"""Decontamination: templates, slots, and the search against a comparison of every document with every item."""

import random
import time

import pytest

from shelfmark.llm import decontaminate

ITEM = "A train leaves Paris at 9 km with 120 people and meets Anna Smith after 35 minutes near the old bridge of stone. How far did it go?"


def found(text, *items, cover=decontaminate.COVER):
    return decontaminate.found_in(text, [decontaminate.Item.read(x, decontaminate.WINDOW) for x in items], cover)


def test_templates():
    read = lambda t: decontaminate.Item.read(t, 5)
    item = read("Mr Smith paid 20 dollars. Then New York paid twenty.")
    assert item.tokens == ["<name>", "paid", "<num>", "<unit>", "then", "<name>", "paid", "<num>"] and item.slots == [0, -1, 0, 0, -1, 1, -1, 1]
    assert read("Tom has $5.50 or 5 million dollars. She left.").tokens == ["<name>", "has", "<num>", "<unit>", "or", "<num>", "<unit>", "she", "left"]
    assert read("").windows == 0 and read("two words").windows == 1


def test_reparameterised_questions():
    tom = "Tom has 3 red apples. Tom buys 4 more red apples at the store. How many red apples does Tom have now?"
    anna = "Anna has 9 red apples. Anna buys 7 more red apples at the store. How many red apples does Anna have now?"
    pay = "A pen costs {} and a book costs {} in the little shop at the corner of the main street. What do both cost?"
    for a, b in ((tom, anna), (pay.format("$5.50", "$3"), pay.format("7 dollars", "12 dollars")), (pay.format("€5", "€7"), pay.format("5 million euros", "twenty five euros"))):
        for x, y in ((a, b), (b, a)):
            item = decontaminate.Item.read(x, 5)
            assert found("some words. " + y + " more of them", x) == [item.windows]
            assert found("some words. " + x + " more of them", x) == [item.windows]


def test_leaks(spark):
    other = ITEM.replace("Paris", "Rome").replace("120", "77").replace("Anna Smith", "Bob").replace("35", "12").replace("9 km", "4 km")
    clean = "This text shares some words with the old bridge of stone and a train that leaves at noon but nothing else of it."
    mixed = ITEM.upper() + "!!"
    rows = [(1, "before " + ITEM + " after"), (2, "x y. " + other), (3, clean), (4, None), (5, ""), (6, ITEM[: len(ITEM) // 3]), (1, "before " + ITEM + " after"), (None, ITEM), (8, mixed), (9, "w " * 300000 + ITEM)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, item_id string, `a.b` int")
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "something wholly different that no document holds at all"), (6, other), (11, ITEM)], "item_id long, text string")
    got = decontaminate.leaks(df, bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.n_items) for r in got) == [(i, 6, 3) for i in ("1", "1", "2", "8", "9", "None")]
    assert {(r.item_id, r.leads) for r in decontaminate.item_classes(bench).collect()} == {(6, 6), (7, 6), (11, 6), (10, 10)}
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0 and decontaminate.leaks(df.limit(0), bench).count() == 0


def test_slots_must_agree():
    base = "the value {} is added to {} and then {} is taken from {} in the end by her"
    item = base.format(5, 8, 5, 8)
    assert found(base.format(3, 4, 3, 4), item, cover=0.9) != [0] and found(base.format(3, 4, 6, 7), item, cover=0.9) == [0]


def test_slots_agree_by_place():
    """An item is found whatever other values it stands with elsewhere in the document."""
    base = "the value {} is added to {} and then {} is taken from {} in the end by her"
    item, rnd = base.format(20, 30, 40, 50), random.Random(6)
    whole = [decontaminate.Item.read(item, 5).windows]
    for gap in (" " + "w " * 200, ". ", "\n"):
        assert found(gap.join([base.format(20, 30, 40, 50), base.format(21, 29, 41, 49)]), item) == whole
        for n in (1, 2, 10):
            texts = [base.format(20, 30, 40, 50), *[base.format(*rnd.sample(range(60), 4)) for _ in range(n)]]
            rnd.shuffle(texts)
            assert found(gap.join(texts), item) == whole


@pytest.mark.parametrize("cover,bits", [(0.5, 28), (0.9, 16), (0.1, 28)])
def test_search_against_all_pairs(spark, sf, monkeypatch, cover, bits):
    monkeypatch.setattr(decontaminate, "MAP_BITS", bits)
    rnd = random.Random(5)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    words = [t.split() for _, t in items]
    # Pieces of items of every length, and items of a few words that are parts of others.
    docs += [(10_000 + n, " ".join(rnd.choice(words)[rnd.randrange(20) :][: rnd.randrange(60)] + rnd.choice(words)[: rnd.randrange(40)])) for n in range(150)]
    items += [(10_000 + n, " ".join(rnd.choice(words)[5:][: rnd.randrange(1, 9)])) for n in range(20)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    lead = {r.item_id: r.leads for r in decontaminate.item_classes(bench).collect()}
    kinds = [(i, decontaminate.Item.read(t, 5)) for i, t in items if lead[i] == i]
    want = set()
    for d, t in docs:
        for (i, item), got in zip(kinds, decontaminate.found_in(t or "", [k for _, k in kinds], cover), strict=True):
            if got:
                want.add((d, i, got, item.windows))
    got = {(r.doc_id, r.item_id, r.windows_found, r.windows) for r in decontaminate.leaks(df, bench, cover=cover).collect()}
    assert got == want and len(want) > 50
    plain = {(d, lead[i]) for d, t in docs for i, x in items if i < 10_000 and x in t}
    assert plain <= {x[:2] for x in want}


def test_many_items_of_one_template(spark):
    """Items of one template are one class: the work does not grow with their number times the documents'."""
    line = "The farmer {} sells {} eggs and {} apples at the old market near the river each day. How many things does {} sell?"
    names = ["Anna", "Bob", "Carl", "Dora", "Emil"]
    items = spark.range(100_000).selectExpr("id as item_id", "concat('The farmer ', element_at(array('Anna','Bob','Carl','Dora','Emil'), cast(id % 5 + 1 as int)), ' sells ', id + 10, ' eggs and ', id + 200000, ' apples at the old market near the river each day. How many things does ', element_at(array('Anna','Bob','Carl','Dora','Emil'), cast(id % 5 + 1 as int)), ' sell?') as text")
    text = " ".join(line.format(n, k, k + 7, n) for k in range(4) for n in names)
    docs = spark.createDataFrame([(i, text) for i in range(50)], "doc_id long, text string")
    began = time.time()
    got = decontaminate.leaks(docs, items).collect()
    assert len(got) == 50 and {(r.item_id, r.n_items) for r in got} == {(0, 100_000)} and time.time() - began < 120
