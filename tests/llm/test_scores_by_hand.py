"""Scores of the language model, languages of texts and toxicity, each from its definition in plain loops."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkledger.llm import language_id, maxent_lm, toxicity
from inkledger.llm.common import tokens

SIZE = maxent_lm.ModelSize(head=6, head_classes=2, tail_classes=3, near=8, far=4, pair_rows=32, word_slots=64, lookup=9, updates=3, word_updates=2, groups=3, train_tasks=2)
TEXTS = ["a b c a b d", "the cat sat on the mat. the end", "", None, "b b b a", "é über straße é a b", "x1 x2 x3 x4 x5 a b c", "a b c d e f g h", "the the cat sat sat"] * 2 + ["a b x9", "unseen words here"]


def attributes(z, head, classes):
    codes = maxent_lm.Codes(z, head, classes)

    def of(word):
        return dict(zip(("near", "far", "cls", "head", "place", "group"), codes.rows[codes[word]], strict=True))

    return of


def stream(text, of):
    """(word, attributes, near bucket before, far bucket before that, group before) of each token."""
    words = [*tokens(text), maxent_lm.END]
    rows = [of(w) for w in words]
    for i, (w, r) in enumerate(zip(words, rows, strict=True)):
        yield w, r, rows[i - 1]["near"] if i else 0, rows[i - 2]["far"] if i > 1 else 0, rows[i - 1]["group"] if i else 0


def scores_by_hand(train, texts, z):
    count = Counter(w for t in train for w in [*tokens(t), maxent_lm.END])
    ranked = sorted(count, key=lambda w: (-count[w], w))
    head = {w: i for i, w in enumerate(ranked[: z.head])}
    classes = maxent_lm.class_of_head(np.array([count[w] for w in ranked[: z.head]]), z)
    of, m = attributes(z, head, classes), maxent_lm.Model(z, classes)
    by_class, by_word, tail = Counter(), Counter(), defaultdict(Counter)
    for t in train:
        for w, r, one, two, before in stream(t, of):
            by_class[one, two, r["cls"]] += 1
            if r["head"] >= 0:
                by_word[one, r["head"]] += 1
            else:
                tail[w][before] += 1
    w_ = {k: np.zeros_like(v) for k, v in m.w.items()}
    features = lambda one, two, c: (("bias", c), ("near", (one, c)), ("far", (two, c)), ("pair", (int(m.pair_rows(one)[two]), c)))
    own = lambda one, h: (("word", h), ("slot", int(m.slots(one)[h])))

    def p_class(one, two):
        e = [math.exp(sum(w_[k][at] for k, at in features(one, two, c))) for c in range(z.classes)]
        return [x / sum(e) for x in e]

    def p_word(one, h):
        e = {g: math.exp(sum(w_[k][at] for k, at in own(one, g))) for g in range(len(head)) if classes[g] == classes[h]}
        return e[h] / sum(e.values())

    for _ in range(z.updates):
        seen, want = ({k: np.zeros_like(v) for k, v in w_.items()} for _ in range(2))
        for (one, two, c), n in by_class.items():
            for k, at in features(one, two, c):
                seen[k][at] += n
        for one, two in {k[:2] for k in by_class}:
            n = sum(by_class[one, two, c] for c in range(z.classes))
            for c, p in enumerate(p_class(one, two)):
                for k, at in features(one, two, c):
                    want[k][at] += n * p
        for (one, h), n in by_word.items():
            for k, at in own(one, h):
                seen[k][at] += n
        for one in {k[0] for k in by_word}:
            for h in range(len(head)):
                n = sum(x for (o, g), x in by_word.items() if o == one and classes[g] == classes[h])
                if n:
                    for k, at in own(one, h):
                        want[k][at] += n * p_word(one, h)
        for k, prior, share in (("bias", 0.1, 4), ("near", 1.0, 4), ("far", 1.0, 4), ("pair", 2.0, 4), ("word", 0.1, 2), ("slot", 1.0, 2)):
            w_[k] = w_[k] + 1.6 / share * (seen[k] - want[k] - prior * 0.05 * w_[k]) / (np.maximum(seen[k], want[k]) + prior)

    kind = lambda w: of(w)["cls"] - z.head_classes
    met = Counter()
    for w, groups in tail.items():
        for g, n in groups.items():
            met[kind(w), g] += n
    bias = {w: math.log(sum(tail[w].values()) + 0.5) for w in tail}
    extra, sums = {(w, g): 0.0 for w in tail for g in range(z.groups)}, None
    for step in range(z.word_updates + 1):
        if step:
            fresh = {}
            for w in tail:
                want = [math.exp(bias[w] + extra[w, g]) / sums[kind(w), g] * met[kind(w), g] for g in range(z.groups)]
                for g in range(z.groups):
                    n = tail[w][g]
                    extra[w, g] += 0.7 * (n - want[g] - extra[w, g]) / (max(n, want[g]) + 1.0)
                c = sum(tail[w].values())
                fresh[w] = bias[w] + 0.3 * (c - sum(want)) / (max(c, sum(want)) + 0.5)
            bias = fresh
        sums = {(k, g): 0.5 + sum(math.exp(bias[w] + extra[w, g]) for w in tail if kind(w) == k) for k in range(z.tail_classes) for g in range(z.groups)}
    out = []
    for t in texts:
        total = 0.0
        for w, r, one, two, before in stream(t, of):
            p = p_class(one, two)[r["cls"]]
            if r["head"] >= 0:
                p *= p_word(one, r["head"])
            else:
                p *= (math.exp(bias[w] + extra[w, before]) if w in tail else 0.5) / sums[kind(w), before]
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("lookup", [9, 1000])
def test_language_model_by_hand(spark, lookup):
    """Every softmax, every update and every word's weight; with words sent to the tasks and with words joined."""
    z = maxent_lm.ModelSize(**{**SIZE.__dict__, "lookup": lookup})
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = [r.score for r in maxent_lm.score_texts(docs, docs.where("doc_id < 16"), size=z).orderBy("doc_id").collect()]
    want = scores_by_hand(TEXTS[:16], TEXTS, z)
    assert all(abs(a - b) < 2e-3 * max(1, abs(b)) for a, b in zip(got, want, strict=True)), list(zip(got, want, strict=True))
    assert len({round(x, 4) for x in want}) > 6


def language_by_hand(text, model):
    """Words scored by sums over their n-grams, the best path over all labels, the share of letters."""
    z, wrap = model.settings, 2**64
    words = language_id.LETTERS.findall((text or "").lower())
    rows = []
    for w in words:
        chars, sums = [2, *map(ord, w), 3], [0.0] * len(model.languages)
        for i in range(len(chars)):
            h = 0
            for n in range(1, 5):
                if i + n > len(chars):
                    break
                h = chars[i] * 0x9E3779B97F4A7C15 % wrap if n == 1 else (h * 0x100000001B3 + chars[i + n - 1] + n) % wrap
                if n == 1 and chars[i] <= 3:
                    continue
                slot = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % wrap >> 40) % z.slots
                sums = [s + float(x) for s, x in zip(sums, model.log[slot], strict=True)]
        sums = [s / 2.5 for s in sums]
        script = next((k for k, (_, a, b) in enumerate(language_id.SCRIPTS, 1) if a <= ord(w[0]) <= b), 0)
        rows.append([s - max(sums) if model.allowed[script][k] else -60.0 for k, s in enumerate(sums)])
    if not words:
        return "und", 0.0
    best, back = rows[0], []
    for row in rows[1:]:
        top = max(range(len(best)), key=lambda k: best[k])
        froms = [k if best[k] >= best[top] - z.switch else top for k in range(len(best))]
        back.append(froms)
        best = [max(best[k], best[top] - z.switch) + row[k] for k in range(len(best))]
    path = [max(range(len(best)), key=lambda k: best[k])]
    for froms in reversed(back):
        path.append(froms[path[-1]])
    share = [0] * len(best)
    for w, k in zip(words, reversed(path), strict=True):
        share[k] += len(w)
    first = max(range(len(best)), key=lambda k: share[k])
    return model.languages[first], share[first] / sum(share)


def test_languages_by_hand(spark):
    en, de, ru = "the and of that is with for this have".split(), "der die das und nicht für ein auch wird".split(), "и не что он на это как так все".split()
    rng = np.random.default_rng(2)
    draw = lambda ws, n: " ".join(rng.choice(ws, n))
    docs = spark.createDataFrame([(i, draw(ws, 30), name) for i, (ws, name) in enumerate([(en, "en"), (de, "de"), (ru, "ru")] * 20)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    texts = [draw(en, 9) + " " + draw(de, 7), draw(ru, 4) + ", " + draw(en, 30), draw(de, 3), "Über THE нет 日本", "", None, "12 ..", *(" ".join(rng.permutation([*en[:4], *de[:4], *ru[:3]])) for _ in range(20))]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        lang, score = language_by_hand(t, model)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-6, t


def tree_by_hand(lines, row, at=0):
    """Walk a printed tree: (prediction, the line after it)."""
    line = lines[at].strip()
    if line.startswith("Predict"):
        return float(line.split(":")[1]), at + 1
    feature, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left, after = tree_by_hand(lines, row, at + 1)
    right, end = tree_by_hand(lines, row, after + 1)
    return (left if row[int(feature)] <= float(cut) else right), end


def pooled(steps):
    """Means of neighbours that fall, weighted, until none does: (first margin, last margin, mean)."""
    blocks = []
    for margin, label, weight in steps:
        blocks.append([margin, margin, label * weight, weight])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            _, last, total, weight = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = last, blocks[-1][2] + total, blocks[-1][3] + weight
    return [(a, b, total / weight) for a, b, total, weight in blocks]


def calibrated(blocks, margin):
    points = [p for a, b, mean in blocks for p in ((a, mean), (b, mean))]
    if margin <= points[0][0]:
        return points[0][1]
    for (a, x), (b, y) in zip(points, points[1:], strict=False):
        if margin <= b:
            return y if b == a else x + (y - x) * (margin - a) / (b - a)
    return points[-1][1]


def test_toxicity_by_hand(spark):
    """Trees walked along their cuts, and the calibration as pooled means of the part kept for it."""
    rng = np.random.default_rng(6)
    calm, rude = "the day was fine and we went on to see our friends there".split(), "you idiot stupid trash shut awful moron really bad".split()
    docs, labels = [], []
    for i in range(400):
        y = int(rng.random() < 0.4)
        docs.append((i, " ".join(rng.choice(calm + rude * (2 * y) + (rude if rng.random() < 0.3 else []), 25))))
        labels.append((i, y))
    z = toxicity.Settings(trees=5, depth=3)
    texts, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(texts, known, settings=z)
    part = {r.doc_id: r.part for r in texts.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(z.seed)), F.lit(4)).alias("part")).collect()}
    reader, label = toxicity.Reader(model.lexicon), dict(labels)
    trees = [(w, t.toDebugString.split("\n")[1:]) for w, t in zip(model.trees.treeWeights, model.trees.trees, strict=True)]
    margin = {i: sum(w * tree_by_hand(t, toxicity.features(text, reader))[0] for w, t in trees) for i, text in docs}
    steps = defaultdict(list)
    for i, _ in docs:
        if part[i] == 3:
            steps[math.floor(margin[i] * 100 + 0.5) / 100].append(label[i])
    blocks = pooled([(m, sum(y) / len(y), len(y)) for m, y in sorted(steps.items())])
    assert len(blocks) > 2
    got = {r.doc_id: r.score for r in model.score(texts).collect()}
    far = [i for i, _ in docs if abs(got[i] - calibrated(blocks, margin[i])) > 1e-6]
    assert not far, [(got[i], calibrated(blocks, margin[i]), margin[i]) for i in far[:5]]
    assert len({round(x, 6) for x in got.values()}) > 3


def test_coded_words_of_a_task_are_bounded():
    """op3: a task starts its table of coded words afresh, so that its memory does not grow with the vocabulary."""
    codes, most = maxent_lm.Codes(maxent_lm.ModelSize(), {}, np.zeros(0, np.int64)), 0
    for k in range(45):
        codes.trim()
        codes.of([" ".join(f"w{k}x{i}" for i in range(10_000))])
        most = max(most, len(codes.rows))
    assert most <= 220_000
