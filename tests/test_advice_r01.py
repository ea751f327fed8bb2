"""Registered queries do the whole job: what earlier filters and keys left out is there."""

import random
import statistics

import pytest

from paperloom.operators import resolve
from paperloom.plans import registry

SF = "/root/testdata/sf0.001"


def looped_rows(boxes):
    """Texts of the rows of one page, each median taken over the whole row again."""
    made = []
    for b in sorted(({**b, "c": (b["y0"] + b["y1"]) / 2} for b in boxes), key=lambda b: (b["c"], b["x0"], b["det_id"])):
        fits = []
        for k, r in enumerate(made[-4:]):
            c, h = statistics.median(x["c"] for x in r), statistics.median(x["y1"] - x["y0"] for x in r)
            top, end = min(x["y0"] for x in r), max(x["y1"] for x in r)
            shared = max(0, min(end, b["y1"]) - max(top, b["y0"])) / max(1, min(end - top, b["y1"] - b["y0"]))
            if abs(b["c"] - c) <= max(4.0, 0.58 * max(h, b["y1"] - b["y0"])) or shared >= 0.45:
                fits.append((abs(b["c"] - c), k, r))
        if fits:
            min(fits, key=lambda f: f[:2])[2].append(b)
        else:
            made.append([b])
    made.sort(key=lambda r: (statistics.median(x["c"] for x in r), min(x["x0"] for x in r)))
    return [" ".join(x["text"] for x in sorted(r, key=lambda x: x["x0"])) for r in made]


def test_rows_and_paragraphs_hold_all_detections(spark):
    clean = [r.asDict() for r in registry.QUERIES["clean_detections"](spark, SF).collect()]
    got = registry.QUERIES["visual_rows"](spark, SF).collect()
    want = [(p, k, t) for p in {b["page"] for b in clean} for k, t in enumerate(looped_rows([b for b in clean if b["page"] == p]))]
    assert sorted((r["page"], r["row"], r["text"]) for r in got) == sorted(want)
    written = registry.QUERIES["page_paragraphs"](spark, SF).collect()
    assert sorted(w for r in written for w in r["markdown"].removeprefix("## ").split()) == sorted(b["text"] for b in clean)


def test_name_scores_find_pairs_without_a_shared_word(spark):
    rng = random.Random(4)
    made = {"khoahoc", "nkhoahoc", "taichinhke", "xaichinhke", "a", "ab", "abcd"}
    while len(made) < 150:
        made.add(" ".join("".join(rng.choices("abcdk", k=rng.randint(1, 12))) for _ in range(rng.randint(1, 3))))
    for n in sorted(made):
        for _ in range(2):
            k = rng.randint(0, min(3, len(n)))
            made.add((n[:k] + rng.choice("abxyz") + n[k + rng.randint(0, 1) :]).strip())
    rng.shuffle(names := sorted(made))
    left, right = names[::2], names[1::2]
    left, right = [*left, "nkhoahoc"], [*right, "khoahoc"]
    entries = spark.createDataFrame([(n, n) for n in sorted(set(left))], "catalog_id string, normalized_name string")
    index = spark.createDataFrame([(n, n) for n in sorted(set(right))], "family_id string, normalized_name string")
    for least in (87.0, 75.0):
        got = {(r["catalog_id"], r["family_id"]): r["score"] for r in resolve.name_scores(entries, index, least).collect()}
        assert got == {(a, b): s for a in left for b in right if (s := resolve.token_set_ratio(a, b)) >= least}
        assert got["nkhoahoc", "khoahoc"] == pytest.approx(1400 / 15)
