from __future__ import annotations

import random

import pytest

from larkspur.operators import suggest


class Tree:
    def __init__(self):
        self.children, self.end = {}, False

    def insert(self, word):
        node = self
        for letter in word:
            node = node.children.setdefault(letter, Tree())
        node.end = True

    def words(self, prefix):
        node = self
        for letter in prefix:
            if letter not in node.children:
                return []
            node = node.children[letter]
        stack, out = [(node, prefix)], []
        while stack:
            node, word = stack.pop()
            if node.end:
                out.append(word)
            stack.extend((n, word + c) for c, n in reversed(node.children.items()))
        return out


def frame(spark, titles):
    return spark.createDataFrame(list(enumerate(titles)), "id long, title string")


def test_worked_example(spark):
    words = suggest.vocabulary(frame(spark, ["Python PyTorch", None, "", "pythonic ruby"]))
    assert [r.word for r in suggest.suggest(words, "py").orderBy("key").collect()] == ["python", "pythonic", "pytorch"]
    assert suggest.suggest(words, "Py").collect() == []
    assert suggest.suggest(words, "x").collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_random_words(spark, seed):
    rng = random.Random(seed)
    titles = [" ".join("".join(rng.choices("abc", k=rng.randrange(1, 5))) for _ in range(4)) for _ in range(20)]
    tree = Tree()
    for title in titles:
        for word in title.split():
            tree.insert(word)
    words = suggest.vocabulary(frame(spark, titles))
    for prefix in ("", "a", "ab", "cb", "zz"):
        got = [r.word for r in suggest.suggest(words, prefix, 100).orderBy("key").collect()]
        assert got == tree.words(prefix)
    assert len(suggest.suggest(words, "").collect()) == min(10, words.count())


def test_long_word_and_empty_table(spark):
    words = suggest.vocabulary(frame(spark, ["x" * 5000]))
    assert suggest.suggest(words, "xx").count() == 1
    empty = spark.createDataFrame([], "id long, title string")
    assert suggest.suggest(suggest.vocabulary(empty), "").collect() == []
