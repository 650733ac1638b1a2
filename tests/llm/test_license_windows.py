"""License templates across line breaks and in long lines, against plain loops over word windows."""

import math
import re

from gleaner.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the\n * following conditions are met"
SCATTERED = "was released early " + "word " * 60 + "the sky under clouds " + "more " * 60 + "a driving license"


def plain(text):
    """Best share of each label over all windows of the whole text."""
    words, best = WORD.findall(text.translate(LOWER)), {}
    for label, template in lic.TEMPLATES:
        listed = WORD.findall(template.translate(LOWER))
        want, reach = set(listed), math.ceil(lic.WINDOW * len(listed))
        most = max((len(set(words[i: i + reach]) & want) for i in range(len(words))), default=0)
        if most >= math.ceil(lic.THRESHOLD * len(want) - 1e-9):
            best[label] = max(best.get(label, 0.0), most / len(want))
    return best


CASES = {1: MIT, 2: "x = 1\n\n# " + BSD.replace("\n", "\n# "), 3: SCATTERED, 4: "word " * 500 + MIT.replace("\n", " ") + " word" * 500,
         5: MIT[:60], 6: "released\nunder\nthe\nMIT\nlicense", 7: SCATTERED + "\n" + BSD + "\n" + "word\n" * 40 + BSD}


def test_windows_equal_brute_force(docs_of):
    docs = docs_of(list(CASES.items()))
    found = {r.doc_id: r for r in lic.scan(docs).collect()}
    for doc, text in CASES.items():
        want = plain(text)
        based = set(filter(None, found[doc].base_labels.split(",")))
        assert set(filter(None, found[doc].labels.split(","))) == set(want) | based, doc
        assert found[doc].score == (1.0 if based else max(want.values(), default=0.0)), doc
    assert found[1].labels == "mit" and found[1].score == 1.0 and found[2].labels == "bsd"
    assert found[3].labels == "" and found[3].score == 0.0
    blocks = sorted(tuple(b) for b in lic.scan_blocks(docs.where("doc_id in (2, 7)")).collect())
    assert blocks == [(2, 2, "bsd", 1.0), (7, 1, "bsd", 1.0), (7, 44, "bsd", 1.0)]
