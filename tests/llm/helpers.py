"""Small tables with the awkward cases, and text to fill them."""

import random

WORDS = "ash birch cedar dogwood elm fir ginkgo hazel ivy juniper kapok larch maple neem oak pine quince rowan spruce teak".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def awkward():
    """(doc_id, text, id, row): nulls, empties, copies, near copies, one word, a very long text, and columns with names that operators use."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    far = " ".join([*words[:40], *prose(9, 40).split(), *words[80:]])
    texts = [None, "", "   ", "one", "one", base, base, near, far, prose(2, 300), prose(3, 4000), "Ünï cödé ß 漢字 " * 30, base + "\n" + prose(4, 30), "a b c d", "A B C D", "x" * 5000, "\n\n\n", "ha " * 400]
    rows = [(i, t, f"clash{i}", -i) for i, t in enumerate(texts)]
    return [*rows, (None, base, "null id", 0), (None, None, "null id", 0), rows[5]]


SCHEMA = "doc_id long, text string, id string, row int"


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
