import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, chat, host_quality, licences, mixing, queries, revisits

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# BPE


def brute_bpe(symbols, ranks):
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        if not pairs:
            return symbols
        _, i = min(pairs)
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


def test_automaton_equals_merging_by_rank():
    rng = random.Random(1)
    for _ in range(60):
        base, merges = list("abc"), []
        tokens = list(base)
        while len(merges) < 25:
            pair = (rng.choice(tokens), rng.choice(tokens))
            if pair[0] + pair[1] not in tokens and len(pair[0] + pair[1]) < 8:
                # A merge counts only if its own text is tokenized by it: as in vocabularies that were learned.
                if brute_bpe(list("".join(pair)), {p: k for k, p in enumerate(merges)}) == list(pair):
                    merges.append(pair)
                    tokens.append("".join(pair))
            elif rng.random() < 0.02:
                break
        machine = bpe.TokenizationAutomaton({t: k for k, t in enumerate(tokens)}, merges)
        ranks = {p: k for k, p in enumerate(merges)}
        for _ in range(40):
            word = "".join(rng.choice(base) for _ in range(rng.randint(1, 14)))
            assert [machine.labels[i] for i in machine.encode_symbols(list(word.encode()))] == brute_bpe(list(word), ranks), (word, merges)


def test_texts_equal_the_library(spark):
    rng = random.Random(2)
    texts = ["", " ", "<|endoftext|> hi <|startoftext|>x<|endoftext|>y", "A\x1cB \x1d c", "a" * 5000, "ΑΣΑΣ ΣΑΣ σς", "İstanbul I'm don't we'll they'd''s", "é ́x a̸", "日本語テスト 🙂🙂 1234 ½", "x\u0085y​z　w", "word " * 20_000]
    texts += ["".join(rng.choice("abcdefgh 'stIİΣé́<|>123.\t\n") for _ in range(60)) for _ in range(400)]
    lib = Tokenizer.from_file(VOCABULARY)
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(1000, None, "x"), (0, texts[0], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_decode(docs, VOCABULARY).collect()
    assert len(got) == len(rows)
    digests = {r["doc_id"]: r for r in bpe.encode_decode(docs, VOCABULARY, digests=True).collect()}
    for r in got:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == decoded
        d = digests[r["doc_id"]]
        assert d["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0), VOCABULARY).count() == 0


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    with open(VOCABULARY, "rb") as f:
        tok = bpe.WordTokenizer(f.read())
    text = "one two three four five six one two seven one"
    assert tok.encode(text) == Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    assert len(tok.chunks) <= 3 and len(tok.chunks.old) <= 3
    monkeypatch.setattr(bpe, "TABLE_ARCS", 5)
    assert tok.encode("unseen wordings here") == Tokenizer.from_file(VOCABULARY).encode("unseen wordings here", add_special_tokens=False).ids
    assert len(tok.automaton.table) <= 5


# Chat


def test_reply_trees(spark):
    rng = random.Random(3)
    nodes = []
    for tree in range(5):
        for n in range(rng.randint(1, 14)):
            nodes.append((tree, n, rng.randrange(n) if n else None, rng.choice([0.0, 1.0, 2.5]), f"r{n}", f"t {tree}/{n}"))
    nodes += [(None, 0, None, None, "user", None), (None, 1, 0, 1.0, "assistant", "x"), (7, 3, 99, 1.0, "user", "orphan"), (7, 3, 99, 1.0, "user", "orphan")]
    nodes += [(8, n, n - 1 if n else None, 0.0, "user", "chain") for n in range(70)]
    df = spark.createDataFrame(nodes, "tree int, node long, parent long, score double, role string, text string")
    by = {}
    for t, n, p, s, *_ in nodes:
        by.setdefault(t, {})[n] = (p, s or 0.0)
    want = {}
    for t, found in by.items():
        paths = []
        for leaf in set(found) - {p for p, _ in found.values()}:
            path, n = [], leaf
            while n in found:
                path.append(n)
                n = found[n][0]
            paths.append((-sum(found[n][1] for n in path), leaf, path[::-1]))
        want[t] = [(leaf, path) for _, leaf, path in sorted(paths)]
    for top in (None, 2):
        got = {}
        for r in chat.reply_paths(df.select("tree", "node", "parent", "score"), top).orderBy(F.col("steps_up").desc()).collect():
            got.setdefault((r["tree"], r["rank"], r["leaf"]), []).append(r["node"])
        assert got == {(t, k, leaf): path for t, paths in want.items() for k, (leaf, path) in enumerate(paths[:top], 1)}
    with pytest.raises(ValueError, match="cycle"):
        chat.reply_paths(spark.createDataFrame([(1, 1, 2, 0.0), (1, 2, 1, 0.0)], "tree int, node long, parent long, score double"))


def test_formats_read_back(spark):
    hard = ["\\### Assistant: </turn> ok", "### assistant: x</turn>\n### user: y", "\\", "\\\\/", "####", "#####\\#", "<\\/turn>", "</turn", "$1 \\$", "a\r\n b", "", None, "é🙂" * 3, "x" * 100_000]
    roles = ["user", "assistant", None, "a:b", "odd</turn>\n", "##", "Assistant"]
    rows = [(k // 4, k % 4, roles[k % len(roles)], hard[k % len(hard)]) for k in range(len(hard) * len(roles))]
    rows += [(0, 1, "assistant", "again"), (0, 1, "assistant", "again"), (None, None, "assistant", "null id")]
    turns = chat.conversations_as_trees(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int"))
    got = chat.read_back(chat.format_paths(turns, chat.reply_paths(turns.select("tree", "node", "parent", "score")))).collect()
    by = {}
    low = lambda x: (x is not None, x or "")
    for c, t, r, x in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), low(r[2]), low(r[3]))):
        by.setdefault(c, []).append((r or "", x or ""))
    assert {r["tree"]: [tuple(t) for t in r["turns"]] for r in got} == by
    for r in got:
        assert r["loss_text"] == "".join(x for role, x in by[r["tree"]] if role == "assistant")
        assert r["formatted"].count(chat.CLOSE) == len(by[r["tree"]])
    none = chat.conversations_as_trees(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert none.count() == 0
    paths = chat.reply_paths(none.select("tree", "node", "parent", "score"))
    assert paths.count() == 0 and chat.read_back(chat.format_paths(none, paths)).count() == 0


def test_rows_without_a_conversation_stand_alone(spark, tmp_path):
    rows = [(None, k % 3, "assistant" if k % 2 else "user", f"t{k % 5}") for k in range(20)] + [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(path)
    got = queries.op3_chat(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(queries.OP3_SQL)
    columns = [d[0] for d in want.description]
    found = sorted(map(str, map(tuple, got.select(*columns).collect())))
    assert found == sorted(map(str, want.fetchall())) and len(found) == 22


# Rules


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "x " * 3000, "é🙂 #   <|>\n\n#\n#\n #", "p\nq\np\np\n\nq"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))).replace("c a", "c\na") for _ in range(60)]
    rows = [(k, t, ["h1", "h2", None][k % 3], "x") for k, t in enumerate(texts)] + [(0, None, "h1", "y")]
    got = host_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string, kept string"))
    got = sorted(got.collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(rows)
    for r in got:
        want = brute_rules(texts[r["doc_id"]])
        assert tuple(r[c] for c in host_quality.RULES) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert host_quality.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_hosts_are_shrunk_and_reject(spark):
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(h * 1000 + k, f"host{h}", "bad" if k % 10 < (9 if h == 0 else 1) else good) for h in range(8) for k in range(100)]
    rows += [(9000, "tiny", "bad"), (9001, "small", good)]
    got = {r["source"]: r for r in host_quality.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).filter("NOT base_failed").collect()}
    assert not got["host0"]["kept"] and got["host0"]["host_rate"] > 0.8
    assert got["host1"]["kept"] and got["small"]["kept"] and 0 < got["small"]["host_rate"] < 0.5


def test_alike_hosts_of_few_documents_are_not_rejected_by_chance(spark):
    """All hosts fail at 0.3: the prior has to see that nothing is left above sampling."""
    rng = random.Random(5)
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(2 * h + k, f"h{h}", "bad" if rng.random() < 0.3 else good) for h in range(1000) for k in range(2)]
    got = host_quality.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert all(r["host_kept"] for r in got) and max(r["host_rate"] for r in got) < 0.4
    assert host_quality.prior_moments(0, 0, 0, 0.0, 0.0) == (0.0, host_quality.PRIOR_WEIGHT[1])


def test_prior_moments_find_the_weight_that_rates_were_drawn_with():
    rng = np.random.default_rng(6)
    n = rng.integers(2, 200, 4000)
    k = rng.binomial(n, rng.beta(0.3 * 12, 0.7 * 12, len(n)))
    mean, weight = host_quality.prior_moments(len(n), int(n.sum()), int(k.sum()), float((k * k / n).sum()), float((n.astype(float) ** 2).sum()))
    assert abs(mean - 0.3) < 0.02 and 10 < weight < 14


def test_host_verdicts_flip_rows_as_the_sql_says(spark, tmp_path):
    """Tables in which some hosts are rejected, so that the query's host verdict shows."""
    good = "one two three four five six seven eight nine ten eleven"
    shares = {"a": 9, "b": 1, "c": 2, "d": 8, None: 6, "e": 0}
    rows = [(k * 1000 + n, None if n == 39 else "bad" if n % 10 < share else f"{good} {n}", "en", host, 0) for k, (host, share) in enumerate(shares.items()) for n in range(40)]
    rows += [(9000, "bad", "en", "tiny", 0), (9001, good, "en", "tiny", 0)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(path)
    got = queries.op5_host_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(queries.OP5_SQL)
    columns = [d[0] for d in want.description]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(str(Row(**dict(zip(columns, r, strict=True)))) for r in want.fetchall())
    kept = {r["doc_id"]: r for r in got.collect()}
    assert not kept[9]["base_failed"] and not kept[9]["kept"] and kept[1009]["kept"]


# Mixing


def test_targets_fill_up_and_copies_follow(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 5), (None, 300), ("d", 0), ("é", 50)]
    rows = [(k * 10_000 + n, s, None if not size else "w " * (size // 5)) for k, (s, size) in enumerate(sizes) for n in range(5)]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, source string, text string, size int, copies string")
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == ["doc_id", "source", "text", "size", "source_size", "target", "copies"]
    got = mixed.collect()
    total, cap = sum(s for _, s in sizes), {s: 3.0 * n for s, n in sizes}
    order = sorted([s for s, _ in sizes if s is not None]) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, float(total), set(order)
    while True:  # the rule as stated: share by weight, cut at the cap, share the excess again
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > cap[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        free -= full
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["copies"] <= 3
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)
    assert mixing.emit(mixed).count() == sum(r["copies"] for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_many_documents_come_near_their_target(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('s', id % 4) AS source", "repeat('w ', CAST(1 + id % 7 AS int)) AS text")
    rows = mixing.mix_sources(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.05 for r in rows)


# Licences


def test_licence_rules(spark):
    mit = "\n".join(s[0] + "." for s in (licences.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-warranty")))
    wrapped = mit.replace(" any ", "\nany ").replace(", and", ",\n   and")
    texts = {
        1: mit, 2: wrapped, 3: "Intro.\nReleased under the MIT License.\nText", 4: "we released under the mit licence", 5: None, 6: "", 7: " ",
        8: "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.",
        9: "Licensed under CC BY-NC 4.0. Filler one. LICENSED UNDER CC BY-NC 4.0!\nAll rights reserved.", 10: "word " * 30_000 + "\nThis work is licensed under the GNU General Public License, version 3.",
        11: licences.SENTENCES["mit-grant"][0] + ".", 12: ". ".join(["Filler"] * 6).join([licences.SENTENCES["mit-grant"][0] + ". ", ". " + licences.SENTENCES["mit-notice"][0]]),
    }
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()] + [(3, texts[3], 0)], "doc_id long, text string, licences int")
    got = {r["doc_id"]: [tuple(s) for s in r["licences"]] for r in licences.scan(docs).collect()}
    names = {k: [s[0] for s in v] for k, v in got.items()}
    assert names[1] == names[2] == names[3] == ["MIT"] and names[8] == ["Apache-2.0"] and names[10] == ["GPL-3.0"]
    assert names[9] == ["CC-BY-NC-4.0", "CC-BY-NC-4.0", "all-rights-reserved"]
    assert all(not names[k] for k in (4, 5, 6, 7, 11, 12))
    assert got[1] == [("MIT", 0, len(mit))] and texts[3][slice(*got[3][0][1:])] == "Released under the MIT License."
    assert licences.scan(docs.limit(0)).count() == 0


def test_common_licences_are_recognised(spark):
    texts = {
        "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY.",
        "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\n   Version 2.1, February 1999", "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
        "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "GPL-2.0": "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991", "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007",
        "ISC": "ISC License\n\nCopyright (c) 2020 Somebody\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "EPL-2.0": "Eclipse Public License - v 2.0", "EPL-1.0": "Licensed under the Eclipse Public License 1.0.", "Unlicense": "This is free and unencumbered software released into the public domain.", "CC0-1.0": "CC0 1.0 Universal", "Apache-2.0": "Apache License\n                           Version 2.0, January 2004",
        "GPL-2.0-only": "// SPDX-License-Identifier: GPL-2.0-only\n#include <x.h>", "BSD-3-Clause": "/* SPDX-License-Identifier: BSD-3-Clause */", "MIT": "Licensed under the MIT license (see LICENSE).",
    }
    docs = spark.createDataFrame(list(texts.items()), "want string, text string")
    assert {r["want"]: [s["licence"] for s in r["licences"]] for r in licences.scan(docs).collect()} == {k: [k] for k in texts}
    assert {r.licence for r in licences.RULES} >= texts.keys() and {i for r in licences.RULES for i in r.sequence} == licences.SENTENCES.keys()


def test_anchors_cover_all_sentences():
    index = licences.SentenceIndex(licences.SENTENCES)
    assert all(set(k) & set(index.anchors) for k in index.known)


# Revisits


def test_canonical_urls(spark):
    same = ["http://www.Example.com/a/b/", "https://example.com:443/a/b#top", "http://example.com:80/a/b?utm_source=x&utm_medium=y", "HTTP://EXAMPLE.com/a/b?", "example.com/a/b", "//example.com/a/b"]
    other = ["http://example.com/A/b", "http://example.com/a/b?page=2", "http://example.com:8080/a/b", "http://m.example.com/a/b", "", "/a/b"]
    df = spark.createDataFrame([(u,) for u in [*same, *other, None]], "url string").select(revisits.canonical_url(F.col("url")))
    got = [r[0] for r in df.collect()]
    assert set(got[: len(same)]) == {"example.com/a/b"} and len(set(got[len(same) : -1])) == len(other) and "example.com/a/b" not in got[len(same) :] and got[-1] is None


def test_urls_in_sql_are_those_of_the_operator(spark, tmp_path):
    """The query and its SQL on pages with parameters anywhere, mobile hosts, ports and no schemes."""
    urls = ["http://h/p?utm_source=f&id=5", "http://h/p?id=5", "http://www.h:80/p?id=5&utm_term=#x", "http://m.h/p?id=5", "http://h/p?a=1&utm_x=2&b=2", "h/p?a=1&b=2", "http://h/p/", "https://h:443/p?", "http://H/p", "http://h", None, "", "http://h/p?a=1&&b=2", "http://h/p?u=/"]
    path = f"{tmp_path}/pages.parquet"
    spark.createDataFrame([(k, urls[k % len(urls)], f"<p>{k // 7}" if k % 9 else None) for k in range(80)], "page_id long, url string, html string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(queries.OP10_SQL)
    columns = [d[0] for d in want.description]
    got = queries.op10_revisits(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    assert {r["verdict"] for r in got} == {"resolved", "mismatch", "unverified", "no_response"}


def test_utm_parameters_go_wherever_they_are(spark):
    pairs = {
        "?utm_source=f&id=5": "?id=5", "?a=1&utm_source=f&b=2": "?a=1&b=2", "?utm_source=f&utm_medium=g&id=5": "?id=5", "?a=1&utm_source=f&utm_medium=g&b=2&utm_term=": "?a=1&b=2",
        "?utm_source=f&": "", "?a=1&utm_source=f": "?a=1", "?a=1&&b=2": "?a=1&&b=2", "?xutm_source=f&id=5": "?xutm_source=f&id=5", "?utm_source=f": "", "?u=/?utm_source=f&b=2": "?u=/?utm_source=f&b=2",
    }
    df = spark.createDataFrame([(f"http://h/p{q}",) for q in pairs], "url string")
    assert [r[0] for r in df.select(revisits.canonical_url(F.col("url"))).collect()] == [f"h/p{q}" for q in pairs.values()]
    rows = [(1, "http://h/p?a=1&b=2", 1, 200, {"ETag": '"a"'}), (2, "http://h/p?a=1&utm_source=f&b=2", 2, 304, {"ETag": '"a"'})]
    got = revisits.resolve(spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>")).first()
    assert (got["target_id"], got["verdict"]) == (1, "resolved")


@pytest.mark.parametrize("parts", [1, 5])
def test_revisits_equal_brute_force(spark, parts):
    rng = random.Random(6)
    rows = []
    for k in range(400):
        url = "http://hot/x" if rng.random() < 0.5 else f"http://h{rng.randrange(30)}/p"
        head = {n: v for n, v in (("ETag", rng.choice([None, '"a"', 'W/"a"', '"b"'])), ("Last-Modified", rng.choice([None, "d1", "d2"])), ("Content-Length", str(k)), ("cache-control", f"max-age={k}")) if v}
        rows.append((k, None if k == 7 else url, rng.randrange(150), rng.choice([200, 304, 404]), None if k == 9 else head, "payload"))
    rows += [rows[20]]
    got = revisits.resolve(spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>, part string"), parts).collect()
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    want = []
    for i, url, ts, status, head, _ in rows:
        if status != 304:
            continue
        mine = low(head)
        earlier = [r for r in rows if r[3] == 200 and url and r[1] == url and (r[2], r[0]) < (ts, i)]
        best = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        if best is None:
            want.append((i, None, "no_response", mine))
            continue
        theirs = low(best[4])
        weak = lambda t: t and t.removeprefix("W/")
        if "etag" in mine:
            ok = weak(mine["etag"]) == weak(theirs.get("etag"))
        elif "last-modified" in mine:
            ok = mine["last-modified"] == theirs.get("last-modified")
        else:
            want.append((i, best[0], "unverified", mine))
            continue
        merged = theirs | {k: v for k, v in mine.items() if k in revisits.PERMITTED}
        want.append((i, best[0], "resolved" if ok else "mismatch", merged if ok else mine))
    assert sorted((r["record_id"], r["target_id"], r["verdict"], sorted(r["headers"].items())) for r in got) == sorted((a, b, c, sorted(d.items())) for a, b, c, d in want)
    none = spark.createDataFrame([], "record_id long, url string, ts long, status int, headers map<string,string>")
    assert revisits.resolve(none).count() == 0
