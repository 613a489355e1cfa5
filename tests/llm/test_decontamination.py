from fieldweave.llm import decontamination as D

ITEM = "If Anna has 12 apples and gives 5 kg to Ben then how many apples does Anna keep for 3 days?"


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): (round(r.coverage, 3), r.kind) for r in D.leaks(d, b).collect()}


def test_copies_templates_and_inconsistent_slots(spark):
    again = ITEM.replace("Anna", "Maria").replace("12", "7,500").replace("Ben", "Tom").replace("5 kg", "2 miles").replace("3 days", "9 weeks")
    docs = [
        (1, "intro words here. " + ITEM + " outro"),
        (2, "Other text. " + again),
        (3, "x " + ITEM.replace("Anna", "Maria", 1)),  # two values for one: not the same question
        (4, "If only half of it: Anna has 12 apples and"),
        (5, "nothing of the kind is in this text at all"),
        (6, ITEM.upper()),
        (7, "a. " + ITEM + " then. " + again),
    ]
    got = found(spark, docs, [(10, ITEM)])
    assert got[1, 10] == (1.0, "copy") and got[2, 10][1] == "template" and got[2, 10][0] > 0.7 and (7, 10) in got
    assert got[3, 10] == (0.5, "copy")  # of the item's 14 windows, the seven without the name that became two
    assert {d for d, _ in got} == {1, 2, 3, 7}


def test_copies_in_any_surroundings(spark):
    """Short items, items of names and numbers, in title case or in capitals: verbatim copies are found whatever stands before them."""
    items = [(1, "What is the capital of France?"), (2, "Paul Met Mary In Rome On Sunday With Eve And Tom"), (3, "WHICH OF THESE NUMBERS IS PRIME AND ODD: 4 6 9 11"), (4, "Ann 12 Bob 13 Cid 14 Dan 15 Eve 16")]
    docs = []
    for i, t in items:
        for k, before in enumerate(("Question: ", "a title line\n", '(he said) ', "It ends here. ", "")):
            docs.append((10 * i + k, before + t + " and so on"))
    docs.append((99, "What is the capital of Spain or of any other country"))
    got = found(spark, docs, items)
    assert got.pop((99, 1)) == (1.0, "template")
    assert set(got) == {(d, d // 10) for d, _ in docs if d < 99} and set(got.values()) == {(1.0, "copy")}


def test_odd_rows(spark):
    long = "lorem ipsum " * 20_000
    docs = [(1, None), (2, ""), (3, "  "), (None, ITEM), (5, long + ITEM), (6, "the answer is short"), (6, "the answer is short"), (7, "1 2 3 4 5 6 7 8 9 10")]
    items = [(1, None), (2, ""), (3, "the answer is short"), (4, "1 2 3 4 5 6 7 8 9 10"), (5, ITEM), (5, ITEM), (None, ITEM)]
    assert found(spark, docs, items) == {(None, 5): (1.0, "copy"), (5, 5): (1.0, "copy"), (6, 3): (1.0, "copy"), (7, 4): (1.0, "copy")}
    assert found(spark, [], items) == {} and found(spark, docs, []) == {}


def test_clean_keeps_columns_and_the_rest(spark):
    d = spark.createDataFrame([(1, ITEM, "a"), (2, "fine", "b"), (None, "fine", None)], "doc_id long, text string, lang string")
    b = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.text, r.lang) for r in D.clean(d, b).collect()) == [(0, "fine", None), (2, "fine", "b")]
