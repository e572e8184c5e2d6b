"""Site quality and decontamination against plain versions of their rules."""

import math
import random

from postlark.llm import decontamination, site_quality


def moments(counts):
    """(good, n, rate around which) of labelled groups: what the upper rate is worth in labels."""
    counts = [c for c in counts if c[1]]
    n, within = sum(c[1] for c in counts), sum(m * r * (1 - r) for _, m, r in counts)
    if not n or not within:
        return 1e4
    between = (sum(m * (g / m - r) ** 2 for g, m, r in counts) - sum(r * (1 - r) for _, _, r in counts)) / n
    return min(max(within / n / between - 1, 2.0), 1e4) if between > 0 else 1e4


def test_site_posteriors_and_score(spark):
    rng = random.Random(5)
    rates = {"a.com/blog": 0.9, "a.com/shop": 0.2, "b.org/x": 0.5, "c.net": 0.8, "hot.io/p": 0.7, "rare.dev/q": 0.5}
    docs, labels = [], []
    for i in range(600):
        place = rng.choice([*rates, *["hot.io/p"] * 6])
        source = rng.choice(["https://", "", "http://"]) + place + rng.choice(["/1?q=a/b", "/2#x"] if "/" in place else [""])
        good = rng.random() < rates[place]
        text = " ".join(rng.choice("one two three four five six seven eight nine ten".split()) for _ in range(120)) + "." if good else "buy now " * rng.randint(5, 40)
        docs.append((i, text, rng.choice(["en", "de"]), source))
        if place != "rare.dev/q" and rng.random() < 0.7:
            labels.append((i, int(good)))
    docs += [(600, "text", None, None), (601, None, "en", "a.com/blog/9"), (602, "", "en", "new.com/z")]
    labels += [(600, 1), (10_000, 1), (3, None), *labels[:20]]

    def key(source, lang):
        if source is None:
            return "\0", lang if lang is not None else "\0"
        steps = source.split("://")[-1].split("?")[0].split("#")[0].split("/")
        return steps[0], "/" + steps[1] if len(steps) > 1 and steps[1] else lang

    truth = {}
    for i, q in labels:
        if q is not None:
            truth[i] = max(q, truth.get(i, 0))
    parts = {}
    for i, _, lang, source in docs:
        c = parts.setdefault(key(source, lang), [0, 0])
        if i in truth:
            c[0] += truth[i]
            c[1] += 1
    overall = (sum(g for g, _ in parts.values()) + 0.5) / (sum(n for _, n in parts.values()) + 1)
    sites = {}
    for (s, _), (g, n) in parts.items():
        c = sites.setdefault(s, [0, 0])
        c[0] += g
        c[1] += n
    m = moments([(g, n, overall) for g, n in sites.values()])
    site_rate = {s: (g + m * overall) / (n + m) for s, (g, n) in sites.items()}
    m = moments([(g, n, site_rate[s]) for (s, _), (g, n) in parts.items()])
    part_rate = {k: (g + m * site_rate[k[0]]) / (n + m) for k, (g, n) in parts.items()}

    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    label_rows = spark.createDataFrame(labels, "doc_id long, quality int")
    model = site_quality.fit_classifier(d, label_rows)
    evidence = model.log_odds(site_quality.features([(t or "").encode() for _, t, _, _ in docs]))
    got = {r["doc_id"]: r for r in site_quality.score(d, label_rows).collect()}
    assert len(got) == len(docs)
    for (i, _, lang, source), e in zip(docs, evidence, strict=True):
        k, r = key(source, lang), got[i]
        rate = min(max(part_rate[k], 1e-4), 1 - 1e-4)
        score = 1 / (1 + math.exp(-(e + math.log(rate / (1 - rate)))))
        assert math.isclose(r["site_rate"], site_rate[k[0]], rel_tol=1e-9) and math.isclose(r["part_rate"], part_rate[k], rel_tol=1e-9), (i, k)
        assert math.isclose(r["evidence"], e, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(r["quality_score"], score, rel_tol=1e-6) and r["kept"] == (r["quality_score"] >= 0.5)
    assert site_rate["new.com"] == overall and len({round(v, 6) for v in part_rate.values()}) > 5


def lines_of(text):
    """(word, whether it begins a sentence or a line) of a text."""
    for line in text.split("\n"):
        begins = True
        for word in line.split():
            yield word, begins
            begins = word[-1] in ".!?:;"


def template(text):
    """(kind, word) of each word: 1 a number, 2 a name, 3 a unit, 0 others."""
    signs = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    words, out = [(w.strip(signs), begins) for w, begins in lines_of(text)], []
    for w, begins in words:
        if not w:
            continue
        number = any(c.isdigit() for c in w) and all(c in "0123456789.,:/-" for c in w)
        name = "A" <= w[0] <= "Z" and not begins and sum("A" <= c <= "Z" for c in w) == 1 and len(w) > 1
        unit = bool(out) and out[-1][0] == 1 and w.lower() in decontamination.UNITS
        out.append((1 if number else 3 if unit else 2 if name else 0, w.lower()))
    return out


def template_windows(text):
    t = template(text)
    slices = [(k, t[k : k + 8]) for k in range(len(t) - 7)]
    return [(k, tuple(kind or w for kind, w in s), [f"{kind}{w}" for kind, w in s if kind]) for k, s in slices if sum(not kind for kind, _ in s) >= 4]


def plain_words(text):
    words = (w.lstrip("\"'`([{").rstrip("\"'`)]}.,;:!?").lower() for w in text.split())
    return [w for w in words if w]


def one(pairs):
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def leak(text, item):
    """(share, changed) of an item in a text, or none."""
    theirs = template_windows(item)
    if not theirs:
        words, own = plain_words(text), plain_words(item)
        n = min(8, len(own))
        if not n:
            return None
        there = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
        windows = [tuple(own[k : k + n]) for k in range(len(own) - n + 1)]
        share = sum(w in there for w in windows) / len(windows)
        return (share, 0) if share >= 0.5 else None
    diagonals = {}
    for i, ours, slots in template_windows(text):
        for j, t, item_slots in theirs:
            if ours == t:
                copies, changed = diagonals.setdefault(i - j, (set(), set()))
                copies.add(j) if slots == item_slots else changed.add((j, tuple(zip(item_slots, slots, strict=True))))
    places, pairs = set(), set()
    for _, (copies, changed) in sorted(diagonals.items(), key=lambda x: (-len(x[1][1]), x[0])):
        if one({p for _, w in changed for p in w}):
            fits = [(j, w) for j, w in changed if one(pairs | set(w))]
            pairs |= {p for _, w in fits for p in w}
            places |= {j for j, _ in fits}
        places |= copies
    share = len(places) / len(theirs)
    return (share, sum(a != b for a, b in pairs)) if share >= 0.5 else None


def test_leaks(spark):
    rng = random.Random(11)
    vocabulary = "a train leaves the station and goes to town with apples for each of them how many are left then".split()
    names, units = ["Anna", "Boris", "Chen", "Dora"], ["km", "kg", "hours", "dollars"]

    def sentence(n):
        out = []
        for _ in range(n):
            x = rng.random()
            out.append(rng.choice(names) if x < 0.1 else f"{rng.randint(1, 40)} {rng.choice(units)}" if x < 0.2 else str(rng.randint(1, 12)) if x < 0.27 else rng.choice(vocabulary) + ("." if x > 0.96 else ""))
        return " ".join(out)

    items = [sentence(rng.randint(10, 30)) for _ in range(25)] + ["2 + 2", "Who wrote it?", "Anna 3 kg Boris 4 kg Chen 5 kg Dora 6 kg", "", "twice said twice said twice said twice said twice said twice said"]

    def renamed(text):
        swap = dict(zip(names, rng.sample(names, len(names)), strict=True))
        return " ".join(swap.get(w, str(int(w) + 50) if w.isdigit() and rng.random() < 0.6 else w) for w in text.split())

    texts = [(k, None if k == 7 else "" if k == 8 else sentence(rng.randint(5, 60))) for k in range(30)]
    for k in range(30, 130):
        item = rng.choice(items)
        put = rng.choice([item, renamed(item), renamed(item), " ".join(item.split()[rng.randint(0, 6) :]), item.replace(" ", "\n", 1), item.upper()])
        texts.append((k, f"{sentence(rng.randint(0, 20))} {put} {sentence(rng.randint(0, 20))}" + (f" {renamed(item)}" if rng.random() < 0.2 else "")))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (round(r["share"], 9), r["changed"]) for r in decontamination.leaks(docs, bench, copied=True).collect()}
    want = {(d, k): (round(found[0], 9), found[1]) for d, text in texts for k, item in enumerate(items) if (found := leak(text or "", item))}
    assert got == want and len(want) > 60 and any(changed for _, changed in want.values())
