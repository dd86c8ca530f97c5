"""Templates and matches against a plain version, and planted questions."""

import re
from collections import Counter

from vigil.llm import decontaminate as dc

NOT = r"[^\x20\x09-\x0D]"


def words(text):
    """(folded, template word, wide template word) of each word with a letter or digit."""
    out, number, gap_before = [], False, ""
    text = text or ""
    for m in re.finditer(f"{NOT}+", text):
        w = m[0]
        gap = text[m.start() - 1 : m.start()]
        first = next((c for c in w if c.isalnum()), "")
        spaced = gap == " " and (text[m.start() - 2] if m.start() > 1 else "") != ""
        prev = text[m.start() - 2] if spaced else ""
        fold = "".join(c for c in w if c.isalnum()).lower()
        unit = number and re.match(rf"(?:{'|'.join(dc.UNITS)})(?![^\W_])", w)
        if first and first in "0123456789":
            narrow = wide = dc.NUMBER
        else:
            narrow = dc.NAME if w[0].isupper() and spaced and not number and (prev.islower() or prev in ",;") else dc.UNIT if unit and gap == " " else fold
            wide = dc.NAME if first.isupper() else dc.UNIT if unit else fold
        number = narrow == dc.NUMBER
        if fold:
            out.append((fold, narrow, wide))
    return out


SLOTS = (dc.NUMBER, dc.NAME, dc.UNIT)


def plain(docs, items, size=dc.SIZE):
    """The docstring's rules, one document and item after another."""
    out, split = set(), [(j, words(t)) for j, t in items]
    kinds = []
    for j, tw in split:
        places = range(len(tw) - size + 1)
        fits = [[sum(x[form] in SLOTS for x in tw[k : k + size]) <= size - least for k in places] for form, least in ((1, dc.LITERAL), (2, dc.WIDE_LITERAL))]
        made = []
        for k in places:
            window = tw[k : k + size]
            made.append((tuple(x[0] for x in window), k, True, fits[0][k] or fits[1][k], ()))
            for form in (1, 2):
                slots = tuple((i, window[i][0]) for i in range(size) if window[i][form] in SLOTS)
                if fits[form - 1][k] and slots:
                    made.append((tuple(x[form] for x in window), k, False, fits[0][k] or fits[1][k], slots))
        kinds.append((j, len(places), sum(fits[0]), made))
    for i, d in docs:
        dw, at = words(d), {}
        for a in range(len(dw) - size + 1):
            for form in range(3):
                at.setdefault(tuple(x[form] for x in dw[a : a + size]), set()).add(a)
        for j, n_item, n_slot, made in kinds:
            by_shift = {}
            for window, k, exact, usable, slots in made:
                for a in at.get(window, ()):
                    by_shift.setdefault(a - k, set()).add((a, exact, usable, tuple((w, dw[a + x][0]) for x, w in slots)))
            for hits in by_shift.values():
                n = Counter(p for h in hits for p in h[3])
                best = {w: min((-c, q) for (v, q), c in n.items() if v == w)[1] for w, _ in n}
                good = [h for h in hits if all(best[w] == q for w, q in h[3])]
                count, whole = len({h[0] for h in good}), min(dc.RUN, n_item)
                fair = 3 * count >= 2 * len({h[0] for h in hits}) and (count >= whole or n_slot and len({h[0] for h in good if h[2]}) >= min(dc.RUN, n_slot))
                if len({h[0] for h in hits if h[1]}) >= whole or fair:
                    out.add((i, j, any(w != q for w, q in n)))
    return {(i, j, max(r for x, y, r in out if (x, y) == (i, j))) for i, j, _ in out}


ITEM = "If a train leaves Paris at 10 km from the old town, how many trains does Anna meet in 25 minutes before she reaches Rome by the sea?"
DOCS = [
    (1, "Nothing here. " + ITEM + " And more."),
    (2, "So, if a train leaves Berlin at 30 km from the old town, how many trains does Otto meet in 99 minutes before she reaches Lima by the sea? yes"),
    (3, ITEM.upper().replace(" ", "!! ")),
    (4, "a few words of it: how many trains does one meet"),
    (5, None),
    (6, ""),
    (7, "word " * 3000 + ITEM.split("how")[1]),
    (8, "how%%% many### trains*** does%%% Anna meet in 25 minutes&&& before%%% she reaches Rome by the sea"),
    (None, ITEM),
    (1, "Nothing here. " + ITEM + " And more."),
]
ITEMS = [(1, ITEM), (2, "Short one."), (3, None), (4, "The sum of 2 and 2 is 4 and the sum of 2 and 3 is what number of apples then"), (9, ITEM)]
DOCS.append((12, "\ue000 " + ITEM.replace("the old", "\ue000the \ue001 old\ue002")))
DOCS.append((10, "now the sum of 5 and 5 is 8 and the sum of 5 and 6 is what number of apples then"))
DOCS.append((11, "now the sum of 5 and 7 is 8 and the sum of 6 and 6 is what number of apples then"))


def test_matches(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (10**6, 0):
        found = {(r.doc_id, r.item_id, r.reworded) for r in dc.matches(docs, items, broadcast=limit).collect()}
        assert found == plain(DOCS, [x for x in ITEMS if x[0] != 9])
    ids = {(d, i) for d, i, _ in found}
    assert {(1, 1), (2, 1), (None, 1), (7, 1), (10, 4), (12, 1)} <= ids and not any(d == 4 for d, _ in ids) and (11, 4) not in ids
    kept = dc.clean(docs.selectExpr("doc_id", "text", "doc_id AS th", "text AS words"), items)
    assert kept.columns == ["doc_id", "text", "th", "words"] and {r.doc_id for r in kept.collect()} == {d for d, _ in DOCS} - {d for d, _ in ids}
    assert dc.matches(docs.limit(0), items).count() == 0 and dc.matches(docs, items.limit(0)).count() == 0


def test_corpus(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id, r.reworded) for r in dc.op8_decontaminate(spark, path).collect()}
    near = [d for d in docs if d[0] in {x[0] for x in found} or d[0] % 4 == 0]
    assert {x for x in found if x[0] in {d[0] for d in near}} == plain(near, items)
