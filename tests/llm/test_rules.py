"""Licence scans, quality rules, mixing, toxicity and the pipeline."""

import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tectra.llm import common, licenses, line_dedup, mixing, ngram_join, pieces, quality, queries, toxicity
from tests.conftest import DATA
from tests.llm.conftest import ordered, rows_of, tuples
from tests.llm.test_near import words_of

SF = f"{DATA}/sf0.001"


def duck_over(duck, docs):
    """A connection whose documents are these rows."""
    c = duck("sf0.001")
    frame = docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow()  # noqa: F841
    c.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM frame")
    c.register("documents", frame)
    return c


@pytest.fixture(scope="module")
def plain(odd):
    """The odd rows whose ids are theirs alone."""
    return odd.filter("doc_id > 18")


NAMES_OF_SCAN = ["doc_id", "rule", "license", "noncommercial", "n_matches", "n_sentences", "recognised"]


def test_licenses(spark, duck, odd):
    names = NAMES_OF_SCAN
    want = duck("sf0.001").sql(queries.ORACLE_SQL["op4_license_scan"]).fetchall()
    assert want and tuples(queries.op4_license_scan(spark, SF), *names) == ordered(want)
    text = ". ".join(licenses.SENTENCES[k - 1] for k in (3, 4, 5, 6)) + "! Other words.\nReleased under the MIT license\nreleased, UNDER the MIT-license"
    docs = odd.unionByName(spark.createDataFrame(rows_of([text], 9000), odd.schema))
    got = tuples(licenses.license_scan(docs), *names)
    assert got == ordered(duck_over(duck, docs).sql(licenses.license_sql()).fetchall())
    assert {(r[1], r[4]) for r in got if r[0] == 9000} == {("mit-text", 1), ("mit-grant", 1), ("mit-notice", 2)}


def test_licenses_in_order(spark, empty):
    docs = spark.createDataFrame(rows_of(["One. Two. Three.", "Two. One.", "One.\nother\nTwo", None, ""]), empty.schema)
    got = licenses.license_scan(docs, ["one", "two"], [("r", "L", [1, 2], False)])
    assert [(r.doc_id, r.n_matches, r.n_sentences) for r in got.orderBy("doc_id").collect()] == [(1, 1, 3), (3, 1, 3)]
    assert licenses.license_scan(empty).count() == 0


def base_of(text):
    """The counts by the letter of their definitions."""
    text = text or ""
    words, seen, dup = words_of(text), set(), 0
    for x in text.split("\n"):
        if words_of(x):
            dup += x in seen
            seen.add(x)
    at = defaultdict(list)
    for k in range(len(words) - 4):
        at[tuple(words[k : k + 5])].append(k)
    repeat = len({k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(5)})
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeat, failed


def brute_quality(rows, min_posterior=0.5, rounds=200):
    """Expectation-maximisation over documents, one by one, in place of patterns."""
    v = np.concatenate([quality.votes(np.array([quality.features(t or "")])) for _, t in rows])
    n, weight = len(rows), max(1.0, 0.001 * len(rows))
    good, bad = (v == 1).sum(1), (v == 0).sum(1)
    post = np.where(bad > 0, (good + 1.0) / (good + 1.0 + 8.0 * bad), 0.9)
    for _ in range(rounds):
        share = (post.sum() + 0.9 * weight) / (n + weight)
        odds = np.full(n, np.log(share) - np.log(1 - share))
        for r in range(v.shape[1]):
            for vote, (right, wrong) in ((1, (0.64, 0.16)), (0, (0.16, 0.64))):
                here = v[:, r] == vote
                other = v[:, r] == 1 - vote
                p = [((w * here).sum() + weight * x) / ((w * (here | other)).sum() + 0.8 * weight) for w, x in ((post, right), (1 - post, wrong))]
                odds[here] += np.log(p[0] / p[1])
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return ordered((i, *base_of(t), not base_of(t)[-1] and bool(p >= min_posterior)) for (i, t), p in zip(rows, post))


def test_quality(spark, odd):
    for docs in (odd, common.table(spark, SF, "documents")):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        got = quality.quality(docs)
        want = brute_quality(rows)
        assert tuples(got, "doc_id", *quality.FEATURES[:5], "base_failed", "kept") == want
        kept = quality.keep_good(docs)
        assert kept.columns == docs.columns and Counter(r[0] for r in kept.select("doc_id").collect()) == Counter(r[0] for r in want if r[-1])


def test_quality_follows_labels(spark):
    """Documents with a good label stay, nearly all of them."""
    found = quality.quality(common.table(spark, f"{DATA}/sf0.01", "documents")).join(common.table(spark, f"{DATA}/sf0.01", "labels"), "doc_id")
    kept = {r.quality: (r.n, r.k) for r in found.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1][1] >= 0.95 * kept[1][0] and kept[0][1] <= 0.6 * kept[0][0]


def test_quality_of_nothing(empty):
    assert quality.quality(empty).count() == quality.keep_good(empty).count() == 0
    assert quality.label_model([]) == {}


def test_mixing(spark, duck, plain):
    names = ["doc_id", "domain", "lang", "source", "epoch"]
    want = duck("sf0.001").sql(queries.ORACLE_SQL["op6_mixing"]).fetchall()
    assert want and tuples(queries.op6_mixing(spark, SF), *names) == ordered(want)
    docs = plain.withColumn("source", F.when(F.col("doc_id") % 5 > 0, F.col("source"))).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.lit("de")))
    taken = mixing.mix_sources(docs)
    assert taken.columns == [c for c in docs.columns if c != "epoch"] + ["epoch"]
    got = taken.select("doc_id", mixing.source_domain(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "epoch")
    assert tuples(got, *names) == ordered(duck_over(duck, docs).sql(mixing.mixing_sql()).fetchall())


def test_mixing_of_odd_rows(odd, empty):
    assert mixing.mix_sources(empty).count() == 0
    taken = mixing.mix_sources(odd, max_epochs=1)  # a budget of all tokens, each once
    leaf_tokens = odd.filter("source is null and lang is null").count()
    assert taken.count() <= odd.count() and leaf_tokens
    assert {r.epoch for r in taken.select("epoch").distinct().collect()} == {0}


def test_shares(spark):
    """What one child can't take goes to its siblings by weight; what all can't take stays with the parent."""
    nodes = spark.createDataFrame([("p", "a", 1, 10, 90), ("p", "b", 1, 100, 90), ("p", "c", 2, 100, 90), ("q", "a", 3, 5, 90), ("q", "b", 1, 6, 90)], "parent string, name string, weight long, capacity long, budget long")
    got = {(r.parent, r.name): r.given for r in mixing.share(nodes, ["parent"], "name").collect()}
    assert got == {("p", "a"): 10, ("p", "b"): 26, ("p", "c"): 53, ("q", "a"): 5, ("q", "b"): 6}


def test_toxicity(spark):
    sf = f"{DATA}/sf0.1"
    labels = common.table(spark, sf, "labels")
    docs = common.cut(common.table(spark, sf, "documents").join(labels.select("doc_id").distinct(), "doc_id", "left_semi"))
    found = toxicity.toxicity(docs, labels)
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(r.toxic, rows[r.doc_id].predicted) for r in labels.collect() if rows[r.doc_id].held_out]
    right = {k: np.mean([p == t for t, p in held if t == k]) for k in (0, 1)}
    assert len(held) > 500 and min(right.values()) >= 0.9, right
    # held-out labels and other columns sway no score
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.toxicity(docs.withColumn("lang", F.lit("x")).withColumn("toxic", F.lit(1)), other, broadcast_labels=0)
    assert {r.doc_id: round(r.score, 9) for r in again.collect()} == {i: round(r.score, 9) for i, r in rows.items()}


def brute_models(train):
    """P(b) and P(b | a) of each class by dictionaries, all entries kept; train holds (text, toxic)."""
    T = toxicity
    seen = [set(), set()]  # by label: (before, a, b)
    for text, label in train:
        w = [None, T._START, *T.words_of(text)]
        seen[label] |= set(zip(w, w[1:], w[2:]))
    pair = [Counter((a, b) for _, a, b in s) for s in seen]
    word = [Counter(b for _, b in p) for p in pair]
    shared = Counter(b for _, b in set(pair[0]) | set(pair[1]))
    n = sum(shared.values())

    def of_word(k, b):
        total = sum(word[k].values())
        return max(word[k][b] - 1, 0) / total + len(word[k]) / total * shared[b] / n

    def of_pair(k, a, b):
        after = {y: c for (x, y), c in pair[k].items() if x == a}
        if not after:
            return of_word(k, b)
        total = sum(after.values())
        return max(after.get(b, 0) - 1, 0) / total + len(after) / total * of_word(k, b)

    left = [len(w) / sum(w.values()) for w in word]
    return of_word, of_pair, shared, left


def brute_evidence(train, texts, ways):
    of_word, of_pair, shared, left = brute_models(train)
    beyond = np.log(left[1] / left[0])

    out = []
    for text in texts:
        w = [toxicity._START, *toxicity.words_of(text)]
        ratios = []
        for a, b in zip(w, w[1:]):
            if shared[b]:
                own, whole = (np.log(p[0] / p[1]) for p in ((of_word(1, b), of_word(0, b)), (of_pair(1, a, b), of_pair(0, a, b))))
            else:  # a word that neither class knows: what the backoffs' weights say
                own = beyond
                after = [weight_after(train, k, a) for k in (0, 1)]
                whole = beyond + np.log(after[1] / after[0])
            ratios.append((own, whole))
        out.append([np.arcsinh(sum(np.log(1 + share * (np.exp(min(power * (o + trust * (x - o)), 50)) - 1)) for o, x in ratios) / (len(w) - 1 + more) / toxicity._UNIT) for share, power, more, trust in ways])
    return np.array(out)


def weight_after(train, k, a):
    pairs = Counter()
    seen = set()
    for text, label in train:
        if label == k:
            w = [None, toxicity._START, *toxicity.words_of(text)]
            seen |= set(zip(w, w[1:], w[2:]))
    for _, x, y in seen:
        if x == a:
            pairs[y] += 1
    return len(pairs) / sum(pairs.values()) if pairs else 1.0


def test_kneser_ney(spark):
    """Evidence against the same models by dictionaries, with the table broadcast and joined; a phrase of ordinary words tells too."""
    r = np.random.default_rng(8)
    plain = [f"w{k}" for k in range(12)] + ["go", "home", "中文", "한국어", "😀"]
    train = []
    for k in range(160):
        w = [str(x) for x in r.choice(plain, int(r.integers(3, 25)))]
        if k % 4 == 0:
            at = int(r.integers(0, len(w)))
            w[at:at] = ["Go", "home"] if k % 8 else ["scum"]
        train.append((" ".join(w) + r.choice(["", ".", "\n!"]), int(k % 4 == 0)))
    of_word, of_pair, shared, _ = brute_models(train)
    for k in (0, 1):  # every history's probabilities add up to one
        assert np.isclose(sum(of_word(k, b) for b in shared), 1) and all(np.isclose(sum(of_pair(k, a, b) for b in shared), 1) for a in [*shared, toxicity._START])
    texts = [t for t, _ in train][:40] + ["", "scum", "go home", "home go", "never seen words", "w1 never w2", "中文 한국어 😀", None, "scum " * 40]
    ways = [toxicity.TRIED[k] for k in (0, 5, 9, 25, 41, 50, len(toxicity.TRIED) - 1)]
    want = brute_evidence(train, [t or "" for t in texts], ways)
    labelled = spark.createDataFrame(train, "text string, toxic int").repartition(3)
    values, beyond = toxicity.key_values(labelled)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    for broadcast_keys in (1_000_000, 0):
        got = {x.id: x.evidence for x in toxicity.evidences(docs, values, beyond, ["id"], broadcast_keys, ways).collect()}
        assert np.allclose([got[k] for k in range(len(texts))], want, rtol=1e-4, atol=1e-3)
    by = dict(zip(texts, want[:, -1]))
    assert by["scum"] > by["home go"] < by["go home"]
    assert len({toxicity.word_keys([w])[0] for w in ("中文", "한국어", "😀", "中")}) == 4


def test_toxicity_of_a_large_table(spark, monkeypatch):
    """A table beyond what is broadcast gives the same evidence, and its lookups move less than the texts do."""
    docs = common.keyed(common.table(spark, f"{DATA}/sf0.01", "documents"), "doc_id", "text").repartition(3)
    labels = common.table(spark, f"{DATA}/sf0.01", "labels").select("doc_id", "toxic").dropna()
    values, beyond = toxicity.key_values(docs.join(labels, "doc_id"))
    n = values.count()
    monkeypatch.setattr(toxicity, "SHARD_KEYS", n // 10, raising=False)

    def found(broadcast_keys, ways):
        return {r.doc_id: r.evidence for r in toxicity.evidences(docs, values, beyond, ["doc_id"], broadcast_keys, ways).collect()}

    def moved():
        of = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(of.apply(k).totalShuffleWrite() for k in range(of.size()))

    ways = [toxicity.TRIED[k] for k in (0, 25, len(toxicity.TRIED) - 1)]
    want, size = found(n, ways), docs.agg(F.sum(F.octet_length("text"))).first()[0]
    for some, most in ((n * 3 // 4, 1.2), (n // 2, 1.2), (n // 10, None)):  # the last ones leave out words as well
        before = moved()
        got = found(some, ways)
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-6, atol=1e-6) for k in want)
        assert most is None or moved() - before < most * size
    got, want = found(n // 2, ways[:1]), found(n, ways[:1])  # the word before isn't trusted
    assert ways[0][3] == 0 and all(np.allclose(got[k], want[k], rtol=1e-6, atol=1e-6) for k in want)


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)] + [(7, None), (None, 1), (8, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 4)}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [False, False]
    assert toxicity.toxicity(empty, labels).count() == 0
    assert len({r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()}) == 1


def test_pipeline(spark, odd):
    """Each stage's result is its operator's, and what a stage drops is gone."""
    docs = common.table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    kept = common.cut(corpus_pipeline.keep_good(spark, docs, SF))
    good = {r[0] for r in brute_quality([tuple(r) for r in docs.select("doc_id", "text").collect()]) if r[-1]}
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == good
    lines = common.cut(corpus_pipeline.drop_lines(spark, kept, SF))
    assert lines.columns == docs.columns and lines.filter("n_chars <> length(text)").count() == 0
    assert tuples(lines.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")), "doc_id", "h") == tuples(line_dedup.line_digests(kept), "doc_id", "kept_sha256")
    one = common.cut(corpus_pipeline.one_of_each(spark, lines, SF))
    assert one.columns == docs.columns and one.count() == ngram_join.ngram_join(lines, 5, 80).filter("doc_id = component_id").count()
    mixed = common.cut(corpus_pipeline.mix(spark, one, SF))
    assert mixed.columns == docs.columns and mixed.count()
    last = corpus_pipeline.run(spark, SF)
    assert tuples(last, "doc_id", "ids_sha256") == tuples(pieces.piece_digests(mixed), "doc_id", "ids_sha256")


def test_pipeline_of_little(spark, empty, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for some in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            some = common.cut(stage(spark, some, SF))
            assert k == 4 or some.columns == docs.columns


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Lesser General Public License for more details."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented"""
BOOST = "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License {} {}available at https://www.eclipse.org/legal/{}"
GNU_TEXT = """GNU {} PUBLIC LICENSE
Version {}

Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""
WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Copyright (C) 2004 Sam Hocevar <sam@hocevar.net>

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."""
BOOST_TEXT = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""
#: Text as published, its rules.
PUBLISHED = [
    (MIT, {"mit-text", "mit-grant"}),
    (APACHE, {"apache-header"}),
    (GPL.format(3), {"gpl3-header"}),
    (GPL.format(2), {"gpl2-header"}),
    (BSD, {"bsd2-text", "bsd3-text"}),
    (ISC, {"isc-grant"}),
    (MPL, {"mpl-header"}),
    (MPL.replace("https", "http"), {"mpl-header"}),
    (CC.format(""), {"cc-by-sentence"}),
    (CC.format("-NonCommercial"), {"cc-by-nc-sentence"}),
    ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
    ("Released under the MIT License.", {"mit-notice"}),
    ("Licensed under the MIT License", {"mit-notice-licensed"}),
    ("Licensed under the Apache License, Version 2.0.", {"apache-notice"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl3-notice"}),
    ("Licensed under CC BY-NC 4.0", {"cc-by-nc-notice"}),
    ("Licensed under CC BY 4.0", {"cc-by-notice"}),
    ("Licensed under CC BY-SA 4.0", {"cc-by-sa-notice"}),
    (LGPL.format("2.1"), {"lgpl21-header"}),
    (LGPL.format("3"), {"lgpl3-header"}),
    (GPL.format(3).replace("GNU General", "GNU Lesser General"), {"lgpl3-program-header"}),
    (GPL.format(3).replace("GNU General", "GNU Affero General"), {"agpl3-header"}),
    (GPL.format(2).replace(" as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.", " version 2 as published by the Free Software Foundation."), {"gpl2-only-header"}),
    (ZLIB, {"zlib-text"}),
    (BOOST, {"boost-notice"}),
    (EPL.format("2.0", "which is ", "epl-2.0/"), {"epl2-notice"}),
    (EPL.format("v2.0", "which accompanies this distribution, and is ", "epl-v20.html"), {"epl2-notice-v"}),
    ("Licensed under the BSD 3-Clause License.", {"bsd3-notice"}),
    ("Licensed under the BSD 2-Clause License.", {"bsd2-notice"}),
    ("Licensed under the ISC License", {"isc-notice"}),
    ("Licensed under the GNU General Public License, version 3.", {"gpl3-notice-licensed"}),
    ("Licensed under the Mozilla Public License, Version 2.0", {"mpl2-notice"}),
    ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", {"apache-text"}),
    (GNU_TEXT.format("GENERAL", "3, 29 June 2007"), {"gpl3-text"}),
    (GNU_TEXT.format("GENERAL", "2, June 1991"), {"gpl2-text"}),
    (GNU_TEXT.format("LESSER GENERAL", "3, 29 June 2007"), {"lgpl3-text"}),
    (GNU_TEXT.format("LESSER GENERAL", "2.1, February 1999"), {"lgpl21-text"}),
    (GNU_TEXT.format("AFFERO GENERAL", "3, 19 November 2007"), {"agpl3-text"}),
    ("Creative Commons Legal Code\n\nCC0 1.0 Universal", {"cc0-text"}),
    ("The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.", {"cc0-deed"}),
    (WTFPL, {"wtfpl-text"}),
    (BOOST_TEXT, {"boost-text"}),
    (ISC.split(", provided")[0] + ".", {"0bsd-grant"}),
    *[(f"This project is made available under the terms of the {n} - see the [LICENSE.md](LICENSE.md) file for details.", {f"notice-{x.lower()}"}) for x, names in licenses.NAMES.items() for n in names[-1:]],
    ("This project is licensed under the MIT License - see the LICENSE file for details.", {"mit-notice-licensed"}),
    ("The source code is licensed under the GNU General Public License, version 3.", {"gpl3-notice-licensed"}),
    ("This library is released under the GPLv3 or later.", {"notice-gpl-3.0-or-later"}),
    *[(f"License: {x}", {f"field-{x.lower()}"}) for x in licenses.IDENTIFIERS],
    *[(f"SPDX-License-Identifier: {x}", {f"identifier-{x.lower()}"}) for x in licenses.IDENTIFIERS],
    *[(f"Licensed under CC {'-'.join(k).upper()} 4.0", {f"cc-{'-'.join(k)}-short"}) for k in licenses._KINDS if k not in (["by"], ["by", "sa"], ["by", "nc"])],
    *[
        (f"This work is licensed under {a} Creative Commons {'-'.join(licenses.CREATIVE_COMMONS[x] for x in k).title()} 4.0 International License.", {f"cc-{'-'.join(k)}-work-{a}"})
        for k in licenses._KINDS
        for a in ("a", "the")
        if a == "the" or k not in (["by"], ["by", "nc"])
    ],
]


def test_published_licenses(spark, duck, empty):
    """Every rule on the published text, as one line, by paragraphs, wrapped, and wrapped in a comment."""
    assert set().union(*(rules for _, rules in PUBLISHED)) == {r[0] for r in licenses.RULES}
    texts, want = [], {}
    for text, rules in PUBLISHED:
        forms = [text, " ".join(text.split())] if "\nCopyright" not in text and "Legal Code" not in text and "\nVersion" not in text else [text]  # titles stand on lines of their own
        for width, prefix, end in () if len(forms) == 1 else ((80, "", "\n"), (70, "", "\r\n"), (72, " * ", "\n"), (40, "# ", "\n"), (76, "dnl ", "\n")):
            lines = [line for part in text.split("\n\n") for line in [*textwrap.wrap(part.strip(), width), ""]]
            forms.append(end.join(["Copyright 2020 Someone", *[prefix + line for line in lines], prefix + "import this"]))
        for form in forms:
            want[len(texts) + 1] = rules
            texts.append(form)
        if len(forms) == 1:  # behind a prefix and by lines of another kind
            for form in (text.replace("\n", "\r\n"), "/*\n" + "\n".join(" * " + line for line in text.split("\n")) + "\n */"):
                want[len(texts) + 1] = rules
                texts.append(form)
    found = defaultdict(set)
    docs = spark.createDataFrame(rows_of(texts), empty.schema)
    got = tuples(licenses.license_scan(docs), *NAMES_OF_SCAN)
    assert got == ordered(duck_over(duck, docs).sql(licenses.license_sql()).fetchall())
    for r in got:
        found[r[0]].add(r[1])
    assert {i: (found[i], texts[i - 1]) for i in want if found[i] != want[i]} == {}


def test_licenses_in_part(spark, empty):
    """A known sentence within a line or sentence of other words is none."""
    assert licenses.license_scan(spark.createDataFrame(rows_of(["This project is not licensed under the MIT License.", "Code licensed under the MIT License may be used - see the LICENSE file for details"]), empty.schema)).count() == 0
    texts = ["It is not released under the MIT license", "Released under the MIT\n\nlicense", "released under the MIT license of\nolden days", "\n" * 100_000 + "Released under\r\nthe MIT license" + "\n" * 100_000]
    got = licenses.license_scan(spark.createDataFrame(rows_of(texts), empty.schema))
    assert [(r.doc_id, r.rule) for r in got.collect()] == [(4, "mit-notice")]


def test_distinct_words_of_any_length():
    """The vote on distinct words depends on the words, not on how many they are."""
    r, at = np.random.default_rng(0), 4
    vote = lambda words: quality.votes(np.array([quality.features(" ".join(words))]))[0, at]
    for n in (1000, 1001, 5000, 20_000, 20_001, 100_000):
        assert vote([f"w{k}" for k in r.integers(0, 50, n)]) == quality.BAD
        assert vote([f"w{k}" for k in r.integers(0, 5000, n)]) == quality.GOOD
    assert quality.distinct_words([b"a", b"b"] * 750) == 4 and quality.distinct_words([]) == 0


def test_license_anchors(spark, empty):
    """Every known sentence holds a word that texts are chosen by, in any case of letters; a known sentence of short words has its longest."""
    anchors = licenses._anchors(licenses.KNOWN)
    assert all(any(a in s.split(" ") for a in anchors) for s in licenses.KNOWN)
    assert licenses._anchors({"a bc": 1, "one two three": 2, "permitted use": 3, "permitted": 4}) == ["permitted", "bc", "three"]
    docs = spark.createDataFrame(rows_of(["A BC.", "a\nbc", "no such", None]), empty.schema)
    assert [r.doc_id for r in licenses.license_scan(docs, {"a bc": 7}, [("r", "L", [7], False)]).orderBy("doc_id").collect()] == [1, 2]
    assert licenses.license_scan(docs, {}, []).count() == 0
