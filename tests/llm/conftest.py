import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept int, n_lines double, pattern string, label string, row int, leaf int, words int, bucket int, component_id string, epoch string, hash string"


def rows_of(texts, first=1):
    """Rows with the texts, with columns whose names operators use themselves."""
    return [(i, t, "en", f"src{i % 4}", len(t or ""), "x", 7, 0.5, "p", "l", 1, 2, 3, 4, "c", "e", "h") for i, t in enumerate(texts, first)]


def random_texts(n, seed=0):
    """Texts of characters and strings that tokenizers treat in a way of their own."""
    r = random.Random(seed)
    odd = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x85", "\xa0", " ", "　", " ", "▁", "﻿", "​", "\x00", "\x01", "\x1a", "'s", "'ll", "'T", "<|endoftext|>", "<|startoftext|>", "<|endof", "</w>", "<s>", "</s>", "<unk>", "<0x0A>", "İ", "ß", "ﬁ", "é", "ال", "中文", "\U0001f600", "ไท", "1234", "²", "...", "-", "_", "#", "Hello", "WORLD", "the", "café", "a" * 90, "ǅ", "Σ", "x̀", "!?"]
    return ["".join(r.choice(odd) if r.random() < 0.75 else "".join(r.choices("abcdeTHERS", k=r.randint(1, 6))) for _ in range(r.randint(1, 25))) for _ in range(n)]


EDGES = [None, "", " ", "\n", "\n\n\n", " \t\r\n", "a", "a b", "word " * 20_000, "x" * 100_000, "one line of more than twenty characters", "ONE line of more than twenty characters  ", "one line of more than twenty characters\nanother", "same text", "same text", "<|endoftext|>", "▁ ▁▁a", "permission is hereby granted. Released under the MIT License."]


@pytest.fixture(scope="session")
def odd(spark):
    """Edge cases, repeated rows, a null id, and an id that different texts share."""
    rows = rows_of(EDGES + random_texts(150))
    rows += [rows[5], rows[10], (None, "no id here at all", None, None, None, *rows[0][5:]), (None, None, None, "src1", 0, *rows[0][5:]), (3, "another text under the id of three", *rows[2][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tuples(df, *columns):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
