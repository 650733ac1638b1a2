"""License scans against plain loops."""

import math
import re
from collections import defaultdict

from gleaner.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in lic.PHRASES.items() for i in range(len(words))
              if words[i: i + len(phrase.split())] == phrase.split()]
    best, labels = 0.0, set()
    for line in (text or "").split("\n"):
        held = set(WORD.findall(line.translate(LOWER)))
        for label, template in lic.TEMPLATES:
            want = set(WORD.findall(template.translate(LOWER)))
            if len(held & want) >= math.ceil(lic.THRESHOLD * len(want) - 1e-9):
                labels.add(label)
                best = max(best, len(held & want) / len(want))
    base = {label for _, label in places}
    return (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else best)


CASES = {
    1: None, 2: "", 3: " .,\n", 4: "the MIT  License. and CC-BY cc by; Cc By 4.0", 5: "mit\nlicense", 6: "xmit license mit licenses",
    7: "Permission is hereby granted, free of charge to any person obtaining copies of this software and documentation files",
    8: "licensed under the apache license, version 2.0", 9: "é MIT LICENSEé gnu general public license gnu general public license",
    10: "word " * 50_000 + "Apache License", 11: "To the extent possible under law the author has waived all copyright and rights to this work",
}


def got(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(tuple(r)[1:])
    return out


def test_all_documents_equal_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = got(lic.op10_licenses(spark, sf_dir))
    assert set(found) == set(texts)
    for doc, text in texts.items():
        assert found[doc] == [plain(text)], doc


def test_edge_cases(docs_of):
    found = got(lic.scan(docs_of([*CASES.items(), (4, CASES[4])])))
    for doc, text in CASES.items():
        assert found[doc] == [plain(text)] * (1 + (doc == 4)), doc
    assert found[7][0][-2] == "mit" and 0.8 <= found[7][0][-1] < 1
    blocks = lic.scan_blocks(docs_of([(1, "a\nb\nReleased under the MIT license")])).collect()
    assert [tuple(b) for b in blocks] == [(1, 2, "mit", 1.0)]


def test_empty_table(docs_of):
    assert lic.scan(docs_of([(1, "a")]).where("doc_id < 0")).count() == 0


def test_text_full_of_phrases(docs_of, by_id):
    found = by_id(lic.scan(docs_of([(1, "x MIT License, " * 60_000), (2, "an MIT licence"), (3, "MIT \u212aicense")])))
    assert (found[1]["n_base"], found[1]["first_word"], found[1]["last_word"], found[1]["base_labels"]) == (60_000, 1, 179_998, "mit")
    assert found[2]["n_base"] == found[3]["n_base"] == 0
