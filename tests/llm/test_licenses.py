import re

import numpy as np
from helpers import docs_of, documents, odd_docs, rows

from themeforge.llm import licenses


def test_templates_and_variants_are_recognised(spark):
    model = licenses.train(documents(spark))
    for family, texts in licenses.TEMPLATES.items():
        for template in texts:
            features = licenses.features_of(template)
            found, probability = licenses.classify(features, model)
            assert found == family and probability >= model["least"]
            assert licenses.confirmed(features, family) == 1.0
    assert licenses.classify([], model)[0] == licenses.UNKNOWN


def test_held_out_wordings(spark):
    texts = [
        "(c) 2020. Released under the MIT License", "This file is licensed under the Apache License, Version 2.0 (the License).",
        "licensed under the GNU General Public License, version 3", "Content licensed under CC BY-NC 4.0.",
        "The license of this house is a matter for the public, and the terms are general.",
        "A river of stories\nReleased under the BSD 3-Clause License.\n\n end",
    ]
    found = rows(licenses.find_licenses(docs_of(spark, texts), licenses.train(documents(spark))))
    shown = {r["doc_id"]: [(x["family"], texts[r["doc_id"]][x["start"] : x["end"]]) for x in r["licenses"]] for r in found}
    assert [v[0][0] if v else None for _, v in sorted(shown.items())] == ["mit", "apache", "gpl", "cc-by-nc", None, "bsd"]
    assert shown[5] == [("bsd", "Released under the BSD 3-Clause License.")]


def test_documents_match_a_plain_search(spark):
    model = licenses.train(documents(spark))
    named = {
        "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    }
    texts = {r["doc_id"]: r["text"] for r in rows(documents(spark))}
    expected = {
        k: [named[line] for line in t.split("\n") if line in named] for k, t in texts.items()
    }
    found = {r["doc_id"]: [x["family"] for x in r["licenses"]] for r in rows(licenses.find_licenses(documents(spark), model))}
    assert found == expected and any(expected.values())


def test_odd_rows_and_empty_tables(spark):
    none = docs_of(spark, [])
    model = licenses.train(none)
    assert rows(licenses.find_licenses(none, model)) == []
    found = {r["doc_id"]: r for r in rows(licenses.find_licenses(odd_docs(spark), model))}
    assert len(rows(licenses.find_licenses(odd_docs(spark), model))) == odd_docs(spark).count()
    assert found[1]["n_paragraphs"] == found[2]["n_paragraphs"] == found[3]["n_paragraphs"] == 0
    assert not any(r["licenses"] for r in found.values())


def test_wrapped_and_dual_notices(spark):
    wrapped = [
        "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated "
        "documentation files, to deal in\nthe Software without restriction, including",
        "The code.\n\nRedistribution and use in source and binary forms, with or\nwithout modification, are permitted "
        "provided that the\nfollowing conditions are met:\n\nmore",
        "you can redistribute it and/or modify it under\nthe terms of the GNU General Public License as published by\n"
        "the Free Software Foundation, either version 2 of the License,\nor any later version.",
        "Dual: Released under the MIT License. Or licensed under the Apache License, Version 2.0.",
        "word " * 500 + "Released under the MIT License. " + "word " * 500 + "Released under the BSD 3-Clause License.",
        "This library is licensed under the GNU Lesser General\nPublic License, version 3.",
    ]
    found = rows(licenses.find_licenses(docs_of(spark, wrapped), licenses.train(documents(spark))))
    shown = {r["doc_id"]: sorted(x["family"] for x in r["licenses"]) for r in found}
    assert shown == {0: ["mit"], 1: ["bsd"], 2: ["gpl"], 3: ["apache", "mit"], 4: ["bsd", "mit"], 5: ["lgpl"]}
    held = {r["doc_id"]: r["licenses"] for r in found}
    assert wrapped[0][held[0][0]["start"] : held[0][0]["end"]].startswith("Permission is hereby granted")


def test_identifiers_and_titles(spark):
    texts = [
        "// SPDX-License-Identifier: Apache-2.0\npackage x", "ISC License\n\nPermission to use, copy, modify, and/or distribute this\n"
        "software for any purpose with or without fee is hereby\ngranted, provided", "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING",
        "The MIT License (MIT)\n\nCopyright", "the spdx list names a license identifier for mit and others",
    ]
    found = rows(licenses.find_licenses(docs_of(spark, texts), licenses.train(documents(spark))))
    shown = {r["doc_id"]: sorted({x["family"] for x in r["licenses"]}) for r in found}
    assert shown == {0: ["apache"], 1: ["isc"], 2: ["epl"], 3: ["mit"], 4: []}


def plain_licenses(text, model, confirm=0.6):
    """Lines and candidate windows, each predicted and then confirmed, in plain loops."""

    def grams(t):
        w = re.findall("[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())
        return {" ".join(w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1)}

    def judged(part):
        own = grams(part)
        every = sorted({g for ts in licenses.TEMPLATES.values() for t in ts for g in grams(t)})
        held = [i for i, g in enumerate(every) if g in own]
        scores = (model["weights"][:, held].sum(1) + model["intercepts"]) / model["temperature"]
        p = np.exp(scores - scores.max())
        p /= p.sum()
        best = int(p.argmax())
        if best == 0 or p[best] < model["least"]:
            return None
        family = model["families"][best]
        share = max(len(own & grams(t)) / len(grams(t)) for t in licenses.TEMPLATES[family])
        return (family, round(float(p[best]), 9), round(share, 9)) if share >= confirm else None

    out, at = [], 0
    for line in text.split("\n"):
        if line.strip() and (hit := judged(line)):
            out.append((at, at + len(line), *hit))
        at += len(line) + 1
    lines = list(out)
    for start, end in licenses.blocks(text):
        for a, b, family, _ in licenses.notices(text, start, end, confirm):
            if any(x[2] == family and x[0] < b and a < x[1] for x in lines):
                continue
            hit = judged(text[a:b])
            if hit and not any(x[2] == hit[0] and x[0] < b and a < x[1] for x in out):
                out.append((a, b, *hit))
    return sorted(out)


def test_documents_match_a_plain_version(spark):
    model = licenses.train(documents(spark))
    texts = {r["doc_id"]: r["text"] for r in rows(documents(spark))}
    extra = {-1 - i: t for i, t in enumerate(
        [t for ts in licenses.TEMPLATES.values() for t in ts] + ["Or ".join(ts) for ts in licenses.TEMPLATES.values()]
    )}
    docs = docs_of(spark, list(extra.values()), -len(extra))
    for frame, given in ((documents(spark), texts), (docs, {-len(extra) + i: t for i, t in enumerate(extra.values())})):
        found = {
            r["doc_id"]: [
                (x["start"], x["end"], x["family"], round(x["probability"], 9), round(x["template_share"], 9)) for x in r["licenses"]
            ] for r in rows(licenses.find_licenses(frame, model))
        }
        for k, text in given.items():
            assert found[k] == plain_licenses(text, model), text[:80]
