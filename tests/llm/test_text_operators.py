"""Exact dedup, line dedup, packing, token ids, SentencePiece, rollups, licence scans and the classifier on small tables."""

import random
import zlib

import numpy as np
import pytest

from convlake.llm import license_scan, line_dedup, packing, quality, token_rollup
from convlake.llm.components import components
from convlake.llm.exact_dedup import exact_dedup
from convlake.llm.sentencepiece_codec import PieceCodec, encode_documents, round_trip
from convlake.llm.tokens import BpeEncoder, vocabulary
from tests.llm import brute

ODD = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a \nb", "\n", "a\n\n b c", "it's 'll  x", "日本 語 <|endoftext|> x", "a\xa0 b 　c", "a\t b\x0b c\x1c d", "x " * 50, "naïve \U0001f600 ok", "▁ mark", "ａ<s>", "é", "\x00\x01", "a" * 3000]
SCHEMA = "doc_id long, text string, text_sha256 string, row int, h int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def test_exact_dedup(spark):
    rng = random.Random(1)
    pool = ["", None, " ", "a b", "a\tb", "a  b", "a b ", "A b", "é", "long " * 4000, "long " * 4000 + "x"]
    rows = [(i, rng.choice(pool)) for i in range(300)] + [(1000 + i, "hot  text") for i in range(400)]
    rng.shuffle(rows)
    got = exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == brute.exact_groups(rows)


def test_exact_dedup_of_repeated_and_null_ids(spark):
    got = exact_dedup(frame(spark, [(None, "a"), (5, "a"), (5, "a"), (7, "a"), (None, "b"), (None, "b")])).collect()
    assert sum(r.kept for r in got) == 2 and len(got) == 6
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(None, 5, 4), (5, 5, 4), (7, 5, 4), (None, None, 2)}
    assert exact_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 3), (6, 2)])
def test_line_dedup(spark, batches, fanout):
    rng = random.Random(batches)
    lines = [f"This is line number {i} of the pool, and it is long enough." for i in range(12)] + ["short", "", "  ", "x" * 40, "é" * 40, "é" * 39]
    rows = [(i, "\n".join(rng.choice((str.upper, str, lambda s: f" {s}\t"))(rng.choice(lines[: 6 + i % 12])) for _ in range(rng.randrange(0, 6)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n\n")]
    rng.shuffle(rows)
    got = line_dedup.line_dedup(frame(spark, rows), batches=batches, fanout=fanout).select("row.doc_id", "kept_text", "n_lines", "n_dropped").collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in got} == brute.line_dedup(rows)


def test_line_dedup_odd_tables(spark):
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0
    line = "A line that every one of these documents holds, all of it."
    got = line_dedup.line_dedup(frame(spark, [(None, line)] * 5)).collect()
    assert all(r.n_dropped == 0 for r in got)
    got = line_dedup.line_dedup(frame(spark, [(None, line)] * 4 + [(3, line)])).collect()
    assert {(r.row.doc_id, r.n_dropped) for r in got} == {(None, 1), (3, 0)}


def test_repeated_ids_are_one_document(spark):
    line = "A line that every one of these documents holds, all of it."
    rows = [(1, line), (1, line), (1, f"{line}\n{line}"), (2, line), (3, f"x\n{line}")]
    got = line_dedup.line_dedup(frame(spark, rows)).collect()
    assert [r.n_dropped for r in got] == [0] * 5
    got = line_dedup.line_dedup(frame(spark, [*rows, (4, line), (5, line)])).select("row.doc_id", "kept_text", "n_dropped").collect()
    assert sorted((r.doc_id, r.n_dropped, r.kept_text) for r in got) == [(1, 1, ""), (1, 1, ""), (1, 2, ""), (2, 1, ""), (3, 1, "x"), (4, 1, ""), (5, 0, line)]


def test_the_anti_join_decides_which_document_keeps_a_line(spark, monkeypatch):
    line = "A line that the first eight of these documents hold, no later one."
    docs = frame(spark, [(i, f"{line if i < 8 else 'Another line, which all of the later documents do hold.'}\nown {i}") for i in range(40)])
    lost = lambda: {r.row.doc_id for r in line_dedup.line_dedup(docs).collect() if r.n_dropped}
    assert lost() == set(range(39)) - {7}
    monkeypatch.setattr(line_dedup.LineRuns, "unseen", lambda self, hashes: hashes.where("false"))
    assert lost() == set(range(8, 39))


def test_a_long_log_of_repeated_lines(spark):
    rows = [(i, "\n".join(f"A line of the log that all the servers wrote down, number {k}" for k in range(20_000))) for i in range(5)]
    got = line_dedup.line_dedup(frame(spark, rows)).collect()
    assert sorted((r.row.doc_id, r.n_dropped, len(r.kept_text)) for r in got) == [*((i, 20_000, 0) for i in range(4)), (4, 0, len(rows[0][1]))]


def test_runs_do_not_depend_on_batches(spark):
    docs = [frame(spark, [(100 - 10 * b + i, f"A line that is shared by some of the batches here: {(b * i) % 4}") for i in range(5)]) for b in range(5)]
    runs = line_dedup.LineRuns(spark, fanout=2)
    fresh = []
    for d in docs:
        fresh.append(line_dedup.unseen_lines(d, runs).count())
        runs.add(line_dedup.line_hashes(d))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    once = line_dedup.LineRuns(spark)
    union = docs[0]
    for d in docs[1:]:
        union = union.unionByName(d)
    once.add(line_dedup.line_hashes(union))
    key = lambda r: [(x.h1, x.h2, x.n_docs, x.keeper) for x in sorted(r.collect())]
    assert key(runs.totals()) == key(once.totals()) and sum(fresh) == len(key(once.totals()))


def test_token_ids_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    own, theirs = BpeEncoder(vocabulary("byte_bpe_50k.tiktoken")), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(3)
    assert own.encode("<|endoftext|> a").tolist() == [50256, 257]
    for text in ODD + ["<|endoftext|> a", "x <|endoftext|><|endoftext|>  y", "<|endoftext|", f"a<|endoftext|>{chr(10) * 5000}b"] + ["".join(rng.choice("ab  \n\t.,'s1é日") for _ in range(40)) for _ in range(300)]:
        assert own.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("mark", [" ", "\n"])
def test_token_ids_of_long_white_space(spark, mark):
    from tokenizers import Tokenizer

    text = f"a{mark * 1_000_000}b"
    theirs = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert BpeEncoder(vocabulary("byte_bpe_50k.tiktoken")).encode(text).tolist() == theirs
    docs = spark.createDataFrame([(1, text, "s", "en")], "doc_id long, text string, source string, lang string")
    assert sum(r.length for r in packing.pack(docs).collect()) == len(theirs) + 1
    assert token_rollup.bpe_counts(docs).first().n_tokens == len(theirs)


def test_added_tokens_in_the_queries(spark):
    docs = spark.createDataFrame([(1, "<|endoftext|> a", "s", "en")], "doc_id long, text string, source string, lang string")
    crc = lambda *ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    pieces = sorted(packing.pack(docs).collect(), key=lambda r: r.start)
    assert [(r.start, r.length, r.doc_tokens, r.ids_crc32) for r in pieces] == [(0, 2, 3, crc(50256, 257)), (2, 1, 3, crc(1))]
    assert token_rollup.bpe_counts(docs).first().n_tokens == 2


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma  ", "d\n"]) for _ in range(rng.choice([0, 1, 5, 300, 900, 5000])))) for i in range(80)] + [(100, None), (None, "x y"), (7000, "z " * 9000)]
    for block in (3_000, 4_000_000):
        pieces = packing.pack(frame(spark, rows).coalesce(2), block_tokens=block).collect()
        bpe, ids = BpeEncoder(vocabulary("byte_bpe_50k.tiktoken")), {}
        for i, t in rows:
            ids[i] = np.append(bpe.encode(t or ""), 1).astype("<u4")
        by_doc, by_sequence = {}, {}
        for p in pieces:
            by_doc.setdefault(p.doc_id, []).append(p)
            by_sequence.setdefault(p.sequence_id, []).append(p)
            assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        assert by_doc.keys() == ids.keys()
        for i, ps in by_doc.items():
            at = 0
            for p in sorted(ps, key=lambda p: p.start):
                assert p.start == at and p.length > 0
                at += p.length
            assert at == len(ids[i])
        sizes = []
        for ps in by_sequence.values():
            at = 0
            for p in sorted(ps, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            sizes.append(at)
        assert all(n == packing.SEQUENCE or n & (n - 1) == 0 for n in sizes) and max(sizes) <= packing.SEQUENCE
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_balances_costs():
    lengths = [random.Random(1).randrange(1, 2000) for _ in range(400)]
    cost = {}
    for _, _, n, at, _ in packing.pack_block(lengths):
        cost[at] = cost.get(at, 0) + packing.LINEAR * n + packing.QUADRATIC * n * n
    full = [cost[i] for i in range(sum(lengths) // packing.SEQUENCE)]
    in_order, at, left = {}, 0, packing.SEQUENCE
    for n in lengths:
        while n:
            take = min(n, left)
            in_order[at] = in_order.get(at, 0) + packing.LINEAR * take + packing.QUADRATIC * take * take
            n, left = n - take, left - take
            if not left:
                at, left = at + 1, packing.SEQUENCE
    assert np.std(full) < np.std(list(in_order.values())[: len(full)])


def test_sentencepiece_ids_are_those_of_the_library(spark):
    import sentencepiece

    file = vocabulary("piece_bpe_32k.model")
    theirs, own = sentencepiece.SentencePieceProcessor(model_file=file), PieceCodec(file)
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choice("abeinrst   thé日\n.A1") for _ in range(60)) for _ in range(400)] + ["▁" * 9 + "a"]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == theirs.encode(text) and own.decode(ids) == theirs.decode(theirs.encode(text))
    rows = frame(spark, [*enumerate(texts), (None, None)])
    got = {r.doc_id: r for r in round_trip(rows).collect()}
    assert len(got) == len(texts) + 1 and got[None].n_tokens == 0
    assert all(got[i].exact == ("▁" not in t) and got[i].n_tokens == len(theirs.encode(t)) for i, t in enumerate(texts))
    assert {r.doc_id: r.ids for r in encode_documents(rows).collect()}[3] == theirs.encode(texts[3])
    assert round_trip(frame(spark, [])).count() == 0


def test_rollup(spark):
    schema = "doc_id long, source string, lang string, version string, n_tokens long"
    make = lambda *rows: spark.createDataFrame([(*r[:3], "v1", r[3]) for r in rows], schema)
    rollup = token_rollup.TokenRollup(spark)
    assert rollup.totals().count() == 0
    first = make((1, "a", "en", 10), (2, "a", "en", 5), (3, None, "de", 7), (4, "b", None, 0))
    assert rollup.commit(1, token_rollup.inserted(first)) and not rollup.commit(1, token_rollup.inserted(first))
    assert rollup.commit(2, token_rollup.revised(make((2, "a", "en", 5)), make((2, "b", "en", 6))))
    read = lambda: {(r.source, r.lang, r.docs, r.tokens) for r in rollup.totals().collect()}
    expected = {("a", "en", 1, 10), ("b", "en", 1, 6), (None, "de", 1, 7), ("b", None, 1, 0)}
    assert read() == expected
    rollup.compact()
    assert read() == expected and not rollup.commit(2, token_rollup.inserted(first)) and read() == expected
    assert rollup.commit(3, token_rollup.deleted(make((3, None, "de", 7))))
    again = token_rollup.TokenRollup(spark, rollup.root)
    assert {(r.source, r.lang, r.docs, r.tokens) for r in again.totals().collect()} == expected - {(None, "de", 1, 7)}
    counts = {r.doc_id: (r.n_tokens) for r in token_rollup.bpe_counts(spark.createDataFrame([(1, None, "a", "en"), (2, "a b", None, "en")], "doc_id long, text string, source string, lang string")).collect()}
    assert counts == {1: 0, 2: 2}


def test_license_scan(spark):
    import duckdb

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    rows = [
        (1, "Text.\nLicensed under the Apache License, Version 2.0.\nMore"), (2, "released under the MIT license"), (3, mit), (4, "Nothing here, permission or not."), (5, None), (6, ""),
        (7, "SPDX-License-Identifier:MIT"), (8, "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0!"), (9, "licensed under the apache license version 2 0 é"), (None, "All rights reserved."),
        (10, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: All rights reserved."),
    ]
    got = {r.doc_id: r for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert {i: r.licenses for i, r in got.items()} == {1: "Apache-2.0", 2: "MIT", 3: "MIT", 4: "", 5: "", 6: "", 7: "MIT", 8: "CC-BY-NC-4.0,GPL-3.0-only", 9: "", 10: "", None: ""}
    assert got[8].kinds == "copyleft,non-commercial" and got[10].sentence_ids == "12,30" and got[None].n_sentences == 1
    assert all(any(w in s for w in license_scan.WORDS) for s in license_scan.SENTENCES.values())
    documents = spark.createDataFrame(rows, "doc_id long, text string").toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    theirs = duckdb.sql(license_scan.duckdb_sql()).fetchall()
    assert sorted(theirs, key=str) == sorted([tuple(r) for r in got.values()], key=str)
    assert license_scan.license_scan(frame(spark, [])).count() == 0


def test_license_rules_match_published_texts(spark):
    gpl = "This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation{} either version {} of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at {}://mozilla.org/MPL/2.0/."
    bsd = "Redistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\nlist of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\nthis list of conditions and the following disclaimer in the documentation\nand/or other materials provided with the distribution.\n\n"
    three = "3. Neither the name of the copyright holder nor the names of its contributors\nmay be used to endorse or promote products derived from this software without\nspecific prior written permission.\n\n"
    end = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND\nANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED\nWARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n"
    expected = [
        (gpl.format(":", ",", 3), "GPL-3.0-or-later"), (gpl.format(";", ";", 3), "GPL-3.0-or-later"), (gpl.format(";", ";", 2), "GPL-2.0-or-later"), (gpl.format(":", ",", 2), "GPL-2.0-or-later"),
        (gpl.format(",", ",", 2).replace("WARRANTY;", "WARRANTY,"), "GPL-2.0-or-later"), (mpl.format("https"), "MPL-2.0"), (mpl.format("http"), "MPL-2.0"), (bsd + three + end, "BSD-3-Clause"), (bsd + end, "BSD-2-Clause"),
        ("/*\n * " + (bsd + three + end).replace("\n", "\n * "), "BSD-3-Clause"), (bsd.replace("\n\n2. ", "\n\n2. Something else.\n\n3. ") + end, ""), (apache, "Apache-2.0"),
        *((f"{a}SPDX-License-Identifier: {x}\nint x;", x) for x in ("MIT", "Apache-2.0", "GPL-3.0-or-later", "BSD-3-Clause") for a in ("", "// ")),
        ("SPDX-License-Identifier: LicenseRef-Mine\nMIT", ""),
    ]
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(frame(spark, [(i, t) for i, (t, _) in enumerate(expected)])).collect()}
    assert [got[i] for i in range(len(expected))] == [x for _, x in expected]
    alone = license_scan.license_scan(frame(spark, list(license_scan.SENTENCES.items()))).collect()
    assert {r.doc_id: r.sentence_ids for r in alone} == {i: str(i) if i > 0 else "" for i in license_scan.SENTENCES}
    assert not any(w.split()[1:] for w in license_scan.WORDS)


def test_more_license_notices_in_plain_and_commented_form(spark):
    terms = "you can redistribute it and/or\nmodify it under the terms of the GNU {} General Public\nLicense as published by the Free Software Foundation{} either\nversion {} of the License, or (at your option) any later version.\n\n"
    hope = "This {} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.\n"
    notices = [
        ("This library is free software; " + terms.format("Lesser", ";", "2.1") + hope.format("library"), "LGPL-2.1-or-later"),
        ("This library is free software: " + terms.format("Lesser", ",", "3") + hope.format("library"), "LGPL-3.0-or-later"),
        ("This program is free software: " + terms.format("Affero", ",", "3") + hope.format("program"), "AGPL-3.0-or-later"),
        ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n", "EPL-2.0"),
        ("To the extent possible under law, the author(s) have dedicated all copyright\nand related and neighboring rights to this software to the public domain worldwide.\n", "CC0-1.0"),
        ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software.\n", "Unlicense"),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n", "ISC"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.\n", "CC-BY-SA-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
        *((f"SPDX-License-Identifier: {x}\n", x) for x in ("BSD-2-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MPL-2.0", "ISC", "EPL-2.0", "CC0-1.0", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0")),
    ]
    forms = [lambda t: t, lambda t: "/*\n * " + t.replace("\n", "\n * ") + "/", lambda t: "# " + t.replace("\n", "\n# ") + "\nx = 1", lambda t: "// " + t.replace("\n", "\n// ").upper()]
    rows = [(i * 10 + k, form(t)) for i, (t, _) in enumerate(notices) for k, form in enumerate(forms)]
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert got == {i * 10 + k: x for i, (_, x) in enumerate(notices) for k in range(len(forms))}
    plain = ["The program is free software to me.", "Version 3 of the license, or any later one, is what I read.", "mit ISC cc0 1.0 EPL 2.0", "All rights  reserved."]
    got = {r.doc_id: (r.licenses, r.sentence_ids) for r in license_scan.license_scan(frame(spark, list(enumerate(plain)))).collect()}
    assert got == {0: ("", ""), 1: ("", ""), 2: ("", ""), 3: ("", "30")}
    long = "word and word. " * 200_000 + notices[0][0] + "word. " * 10
    got = license_scan.license_scan(frame(spark, [(1, long), (1, long)])).collect()
    assert [r.licenses for r in got] == ["LGPL-2.1-or-later"] * 2


def test_a_late_batch_counts_after_compacting(spark):
    one = spark.createDataFrame([(1, "a", "en", "v1", 10)], "doc_id long, source string, lang string, version string, n_tokens long")
    rollup = token_rollup.TokenRollup(spark)
    read = lambda: [(r.docs, r.tokens) for r in rollup.totals().collect()]
    assert rollup.commit(1, token_rollup.inserted(one)) and rollup.commit(3, token_rollup.inserted(one))
    rollup.compact()
    assert not rollup.commit(1, token_rollup.inserted(one)) and not rollup.commit(3, token_rollup.inserted(one)) and read() == [(2, 20)]
    assert rollup.commit(2, token_rollup.inserted(one)) and read() == [(3, 30)]
    rollup.compact()
    rollup.compact()
    again = token_rollup.TokenRollup(spark, rollup.root)
    assert [again.committed(i) for i in range(5)] == [False, True, True, True, False] and read() == [(3, 30)]
    assert again.commit(4, token_rollup.deleted(one.unionByName(one))) and read() == [(1, 10)]


def test_rollup_of_empty_repeated_and_long_rows(spark, tmp_path):
    from convlake.llm import queries

    schema = "doc_id long, text string, lang string, source string, version int, docs int, tokens int"
    for name, rows in (("none", []), ("some", [(1, "a b", "en", "s", 1, 1, 1), (1, "a b", "en", "s", 1, 1, 1), (2, "x " * 300_000, None, None, 1, 1, 1), (None, None, "de", "s", 1, 1, 1)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert queries.op6_token_counts(spark, f"{tmp_path}/none").count() == 0
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in queries.op6_token_counts(spark, f"{tmp_path}/some").collect()}
    assert got == {("s", "en", "byte_bpe_50k"): (2, 4), ("s", "en", "words"): (2, 4), (None, None, "byte_bpe_50k"): (1, 300_001), (None, None, "words"): (1, 300_000), ("s", "de", "byte_bpe_50k"): (1, 0), ("s", "de", "words"): (1, 0)}


def test_dual_coordinate_descent_reaches_the_minimum():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 40, rng.integers(3, 12))).astype(np.int32) for _ in range(60)]
    good, ratios = rng.random(60) > 0.4, np.zeros(quality.DIMENSIONS)
    ratios[:40] = rng.normal(size=40)
    own = quality.dual_coordinate_descent(rows, good, ratios, cost=1.0, rounds=2_000)
    x = np.zeros((60, 40))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / np.sqrt(len(r))
    y, most = np.where(good, 1.0, -1.0), np.where(good, 60 / (2 * good.sum()), 60 / (2 * (~good).sum()))
    primal = lambda w: 0.5 * w @ w + (most * np.maximum(0, 1 - y * (x @ w))).sum()
    alpha, step = np.zeros(60), 1 / np.linalg.eigvalsh((x @ x.T) * np.outer(y, y)).max()
    for _ in range(50_000):  # plain projected gradient on the dual
        alpha = np.clip(alpha - step * (y * (x @ (x.T @ (alpha * y))) - 1), 0, most)
    w = own[:40] / np.where(ratios[:40] == 0, 1, ratios[:40])
    assert primal(w) <= primal(x.T @ (alpha * y)) * 1.001 + 1e-6


def test_log_count_ratios():
    rows, good = [np.array([0, 1]), np.array([0, 2]), np.array([0, 1, 2])], np.array([True, False, True])
    got, a = quality.log_count_ratios(rows, good), quality.ALPHA
    share = lambda k, n: (k + a) / (n + 2 * a)
    assert np.allclose(got[:4], np.log([share(2, 2) / share(1, 1), share(2, 2) / share(0, 1), share(1, 2) / share(1, 1), share(0, 2) / share(0, 1)]))


def test_quality_of_repeated_and_long_rows(spark):
    text = "Some words that are good enough, in a sentence. "
    rows = [(i, text * (1 + i % 7) if i % 2 else "BAD!! " * (1 + i % 9)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    once = {r.doc_id: r.score for r in quality.quality(frame(spark, rows), labels).collect()}
    thrice = quality.quality(frame(spark, rows * 3 + [(500, text * 40_000), (501, None)]), labels).collect()
    assert len(thrice) == 602 and all(abs(once[r.doc_id] - r.score) < 1e-9 for r in thrice if r.doc_id in once)
    few = quality.fit(frame(spark, rows), labels, most_indicators=2_000)
    assert few.score(rows[1][1]) > few.score(rows[0][1])


def test_quality(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "te") for b in ("n", "r", "st", "ve")]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5, 200))).capitalize() + "."
    bad = lambda: rng.choice([good().upper() + "!!", " | ".join(good().split()), (rng.choice(words) + " ") * rng.randrange(10, 90)])
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(600)] + [(9000, None), (9001, ""), (None, "one two"), (9002, "x")]
    labels = spark.createDataFrame([(i, None if i == 3 else int(i % 5 != 0), 0) for i in range(600)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 5 != 0) for r in held) / len(held) > 0.97
    assert quality.quality(frame(spark, []), labels).count() == 0
    assert {r.score for r in quality.quality(frame(spark, rows[:5]), labels.where("quality = 1")).collect()}.__len__() == 1


def test_components(spark):
    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(100, 160)]
    links = chain + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ends = [(a, b) for a, b in links if a is not None and a != b]
    assert got == brute.smallest_reachable({x for e in ends for x in e}, ends)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
