"""Mentions of names that begin alike, are long, or end in other characters, against a search of every text."""

import random
import re

from vellum.operators import graph


def test_equal_to_a_search_of_every_text(spark):
    rng = random.Random(5)
    names = ["Brand#1.md", "Brand#12.md", "a.md", "a b c d e.md", "a b c d f.md", "(a).md", "a (1)", "x-y_z.md", "md", "é.md", "a\nb.md", "a.md.", "..."]
    parts = [*names[:-1], "Brand#", "1", "2.md", " ", "-", "_", "x", "(", ")", "\n", ".", "a b c d"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 6])))) for i in range(400)] + [(400, None)]
    notes, known = spark.createDataFrame(texts, "path long, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    want = sorted((n, i) for n in names[:-1] for i, t in texts if re.search(rf"(?<![A-Za-z0-9_-]){re.escape(n)}(?![A-Za-z0-9_-])", t or ""))
    assert sorted(map(tuple, graph.mentioned(notes, known).collect())) == want
    assert {n for n, _ in want} == set(names[:-1])


def test_names_that_begin_alike_do_not_all_meet_a_text(spark):
    names = spark.createDataFrame([(f"Brand#{i}.md",) for i in range(25)], "name string")
    notes = spark.createDataFrame([(i, f"see (Brand#{i % 25}.md)") for i in range(100)], "path long, text string")
    assert graph.candidates(notes, names).count() == 100 == graph.mentioned(notes, names).count()
