"""Passages that templates alone do not find."""

from vigil.llm import decontaminate as dc


def found(spark, docs, items):
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    first, *rest = [sorted((r.doc_id, r.item_id, r.reworded) for r in dc.matches(docs, items, broadcast=b).collect()) for b in (10**6, 0)]
    assert rest == [first]
    bad = {r[0] for r in first}
    assert {r.doc_id for r in dc.clean(docs, items).collect()} == {r.doc_id for r in docs.collect()} - bad
    return first


def test_other_letter_case(spark):
    item = "First, sort the list, then take the least, then drop the rest, and say, in a word, what is left of it."
    docs = [(1, item.upper()), (2, item.lower()), (3, "So: " + item), (4, "FIRST, SORT THE LIST, THEN GO HOME AND SAY NOTHING OF IT TO ANYONE ELSE.")]
    assert found(spark, docs, [(7, item)]) == [(1, 7, False), (2, 7, False), (3, 7, False)]


def test_items_of_one_template(spark):
    first, second = ("A box holds 3 red balls and {} more are then put into it, so how many balls of either kind does the box hold now".format(n) for n in (3, 5))
    docs = [(1, "Well: " + second), (2, first), (3, "A box holds 7 red balls and 9 more are then put into it, so how many balls of either kind does the box hold now")]
    got = found(spark, docs, [(1, first), (2, second), (3, second)])
    assert {(1, 2, False), (2, 1, False), (3, 2, True)} <= set(got) and not any(i == 3 for _, i, _ in got)


def test_many_numbers(spark):
    item = "Compute 12 + 7 - 4 * 9 / 3 + 88 - 5 * 6 and give 2 digits"
    docs = [(1, "Task. " + item), (2, item.replace("*", "x") + " or so"), (3, "Compute 1 + 2 - 3 * 4 / 5 + 6 - 7 * 8 and give 9 digits")]
    got = found(spark, docs, [(4, item)])
    assert got == [(1, 4, False)]
    rows = dc.matches(*(spark.createDataFrame([(1, item)], f"{k} long, text string") for k in ("doc_id", "item_id"))).collect()
    assert [(r.n_windows, r.n_item) for r in rows] == [(6, 6)]


def test_signs_and_one_other_number(spark):
    item = "If a train leaves Paris at 10 km from the old town, how many trains does Anna meet in 25 minutes before she gives Anna a call from the sea?"
    long = item + " And when the train has left the old town for good, then Anna goes on foot for 10 km and takes a rest of 25 minutes by the big lake before Anna turns back."
    docs = [
        (1, item.replace("gives Anna", "gives Anna,")),
        (2, item.replace("25", "25,")),
        (3, long.replace("Anna", "Maria").replace("for 10 km", "for 12 km")),
        (4, item.replace("gives Anna", "gives Otto").replace("10", "30").replace("from the sea", "from a hill")),
    ]
    got = found(spark, docs, [(1, item), (2, long)])
    assert {(1, 1, False), (2, 1, False), (3, 2, True)} <= set(got)


def test_names_at_the_start_of_sentences(spark):
    item = "Alice has 5 apples and 2 pears. Alice gives Bob 3 apples. Alice then buys 4 kiwis. Bob eats one of the pears. How many pieces of fruit does Alice have now?"
    other = item.replace("Alice", "Maria").replace("Bob", "Otto")
    docs = [(1, other), (2, other.replace(". ", ".\n")), (3, 'He said: "' + other.replace("Otto", '"Otto"') + '"'), (4, other.replace("Maria gives", "Karl gives").replace("does Maria", "does Emil"))]
    got = found(spark, docs, [(1, item)])
    assert {(1, 1, True), (2, 1, True), (3, 1, True)} <= set(got)
