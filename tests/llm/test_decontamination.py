"""Decontamination: recall on re-parameterised questions, precision on others, parts of runs, both ways of matching."""

import random

import pytest

from tidewatch.llm import decontamination

NAMES = "Tom Ann Bob Eve Carla Dmitri Farah Grace Hiro Ines Jack Karim Lena Marta Nils Olga Pedro Rosa Sven Tara".split()
UNITS = ["kg", "lb", "oz", "pounds", "grams", "kilograms"]
MONEY = ["dollars", "euros", "pesos", "rupees"]
ITEMS = [
    "{A} has {n} red apples. {A} gives {m} apples to {B}. {B} eats {k} of them and hands the rest back to {A}. How many apples does {A} hold now?",
    "{A} bought {n} {u} of rice for {m} {c} and {k} {u} of beans for {j} {c}. What did {A} pay for everything in the basket?",
    "A baker makes {n} loaves every morning and sells each of them for {m} {c}. {A} works there for {k} days. What does the baker earn in that time?",
    "{A} runs {n} miles on Monday. On Tuesday {B} runs {m} miles more than {A} did. Together with {D} they ran {k} miles. How far did {D} run?",
    "In a class of {n} pupils {m} play chess and {k} play tennis. If {j} pupils do both, how many of them do neither of the two?",
    "{A} and {B} share {n} marbles. {B} takes {m} marbles more than {A} takes. How many marbles does each of the two children get in the end?",
    "A tank holds {n} liters of water. It loses {m} liters in the first hour and {k} liters in every hour after that. When will it be empty?",
    "{A} reads {n} pages a day, {B} reads {m} pages a day. They start the same book together. After {k} days how many pages is {A} ahead of {B}?",
]


def filled(form, rng):
    a, b, d = rng.sample(NAMES, 3)
    n, m, k, j = rng.sample(range(2, 500), 4)
    return form.format(A=a, B=b, D=d, n=n, m=m, k=k, j=j, u=rng.choice(UNITS), c=rng.choice(MONEY))


@pytest.mark.parametrize("most", [decontamination.MOST_WINDOWS, 0])
def test_recall_of_rewritten_questions(spark, most):
    rng = random.Random(11)
    items = [(k, filled(f, rng)) for k, f in enumerate(ITEMS)]
    fill = "the weather was mild that week and people walked along the river until it became dark".split()
    docs, holds = [], set()
    for n in range(240):
        around = [" ".join(rng.sample(fill, 12)) for _ in range(2)]
        if n % 2:
            k = rng.randrange(len(ITEMS))
            holds.add((n, k))
            docs.append((n, f"{around[0]}. {filled(ITEMS[k], rng)} {around[1]}"))
        else:
            docs.append((n, f"{around[0]}. {rng.choice(NAMES)} has {rng.randint(2, 99)} books and sells {rng.randint(2, 9)} of them. {around[1]}"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find(d, b, most_windows=most).collect()}
    assert len(got & holds) >= 0.95 * len(holds)
    assert not {i for i, _ in got} - {i for i, _ in holds}


def test_runs_are_cut_where_slots_contradict(spark):
    item = "A train leaves Paris at 9 with 120 people and then Anna counts 35 people more in the train to Paris"
    docs = [
        (1, item.replace("leaves Paris", "leaves Rome")),  # 20 tokens before the contradiction
        (2, "A train leaves Rome at 9 with 120 people on board, said Anna, and the train to Paris is late"),
        (3, item.upper()),
        (4, "one two three four"), (5, "well, one two three four it is"), (6, "ONE two. three four!"),
        (7, "7 8 9 10 11 12 13 14 15 16 17 18 19 20"), (8, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"),
    ]
    items = [(9, item), (8, "one two three four"), (7, "7 8 9 10 11 12 13 14 15 16 17 18 19 20")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (decontamination.MOST_WINDOWS, 0):
        got = {(r.doc_id, r.item_id): (r.tokens, r.changed) for r in decontamination.find(d, b, most_windows=most).collect()}
        assert set(got) == {(1, 9), (4, 8), (6, 8), (7, 7)}
        assert got[1, 9] == (20, 1) and got[7, 7] == (14, 0)


def test_drop_contaminated(spark):
    item = "seven plain words make this item here"
    rows = [(1, f"so {item} it is", 1), (2, "clean", 2), (None, item, 3), (4, None, 4), (5, "", 5), (1, "other text of the same id", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _held int")
    b = spark.createDataFrame([(1, item), (None, None)], "item_id long, text string")
    assert sorted(r._held for r in decontamination.drop_contaminated(df, b).collect()) == [2, 3, 4, 5]
    assert decontamination.drop_contaminated(df.where("false"), b).count() == 0
    assert decontamination.drop_contaminated(df, b.where("false")).count() == 6
