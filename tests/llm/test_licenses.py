import random
import re

import numpy as np

from paperloom.llm.licenses import PHRASES, TEMPLATES, Automaton, Scanner, best_cover, license_scan, license_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_columns_against_brute_force(odd, none):
    rng = random.Random(3)
    pieces = ["Under THE mit-license", "apache license, version 2", "cc by nc", "cc-by", "the", "é", "mit", "license", "under", "apache", "2", "日本", "\n", "cc by nc by nc"]
    scanner = Scanner()
    for _ in range(300):
        t = " ".join(rng.choice(pieces) for _ in range(rng.randrange(20)))
        r = scanner.row(t)
        assert tuple(r[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == brute(t), t
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
    got = {(r["doc_id"], r["n_words"], r["n_base"]) for r in license_scan(odd).collect()}
    assert got == {(r["doc_id"], *brute(r["text"])[:2]) for r in odd.collect()}
    assert license_scan(none).count() == 0


def test_matching_statistics_against_brute_force():
    rng = random.Random(4)
    templates = [("a", [bytes([97 + rng.randrange(4)]) for _ in range(30)]) for _ in range(4)]
    auto = Automaton(templates)
    texts = {bytes().join(w) for _, w in templates}
    for _ in range(200):
        words = [bytes([97 + rng.randrange(5)]) for _ in range(rng.randrange(40))]
        longest = []  # longest template passage that ends at each word
        for end in range(1, len(words) + 1):
            longest.append(max((n for n in range(end + 1) if any(b"".join(words[end - n : end]) in t for t in texts)), default=0))
        want = [(i + 1 - n, n) for i, n in enumerate(longest) if n >= 3 and (i + 1 == len(longest) or longest[i + 1] != n + 1)]
        got = auto.passages(np.array([auto.number.get(w, -1) for w in words], np.int64), 3)
        assert [(a, n) for a, n, _ in got] == want
        for a, n, s in got:
            assert all(b"".join(templates[t][1][e - n : e]) == b"".join(words[a : a + n]) for t, e in auto.ends[s])


def test_each_template_gives_its_own_label_alone():
    scanner = Scanner()
    for label, text in TEMPLATES:
        r = scanner.row("Some words before. " + text + " And after.")
        assert r["labels"] == label and r["score"] > 0.9, label
        words = license_words(text)
        assert (3, 3 + len(words)) in {(x["first_word"], x["end_word"]) for x in r["spans"]}, label
    assert {"bsd-2-clause", "bsd-3-clause", "cc-by-nc-nd", "mpl-2", "lgpl-2.1"} <= {x for x, _ in TEMPLATES}


def test_broken_templates_and_others():
    scanner = Scanner()
    mit = next(t for x, t in TEMPLATES if x == "mit").split()
    broken = " ".join(mit[:40] + ["really"] + mit[41:80] + ["indeed", "so"] + mit[82:])
    assert scanner.row(broken)["labels"] == "mit"
    assert scanner.row("the of and to a in is it you that he was for on are as with his they")["score"] == 0.0
    assert license_words("A-b_é9") == [b"a", b"b", "é9".encode()]
    two = scanner.row(TEMPLATES[0][1] + " And besides: " + next(t for x, t in TEMPLATES if x == "bsd-3-clause"))
    assert two["labels"] == "bsd-3-clause,mit"


def test_spans_against_brute_force():
    """Template passages that stand apart by unknown words: spans are the places of the longest, chained over small gaps."""
    rng = random.Random(8)
    word = lambda k: f"w{k}".encode()
    texts = [[word(1000 * t + k) for k in range(30)] for t in range(4)]  # no word is shared or repeated
    scanner = Scanner(templates=tuple((f"t{t}", " ".join(w.decode() for w in x)) for t, x in enumerate(texts)))
    for _ in range(200):
        words, want = [], []
        for _ in range(rng.randrange(4)):
            t, a = rng.randrange(4), rng.randrange(20)
            n = rng.randrange(1, 31 - a)
            words += [b"x"] * 9  # a gap too wide for a chain
            cut = rng.randrange(n + 1)
            gap = rng.randrange(9)
            passages = [texts[t][a : a + cut], texts[t][a + cut : a + n]]
            first = len(words)
            words += passages[0] + [b"x"] * gap + passages[1]
            if not gap or not cut or cut == n:
                passages, starts = [texts[t][a : a + n]], [first + (gap if not cut else 0)]
            else:
                starts = [first, first + cut + gap]
            long = [(s, len(p)) for s, p in zip(starts, passages) if len(p) >= 4]
            if long:
                want.append((t, long[0][0], long[-1][0] + long[-1][1], sum(n for _, n in long) / 30))
        got = scanner.spans(words)
        assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])


def test_best_cover_against_sets():
    rng = random.Random(9)
    lengths = [10, 20, 40]
    for _ in range(300):
        spans = []
        for _ in range(rng.randrange(8)):
            t, a = rng.randrange(3), rng.randrange(60)
            spans.append((t, a, a + rng.randrange(1, 30), rng.randrange(1, lengths[t] + 1) / lengths[t]))
        left, taken, under = sorted(spans, key=lambda x: (-round(x[3] * lengths[x[0]]), -x[3], x[1], x[0])), [], set()
        for x in left:
            mine = set(range(x[1], x[2]))
            if len(mine & under) <= len(mine) / 2:
                taken.append(x)
                under |= mine
        assert best_cover(spans, lengths, 100) == sorted(taken, key=lambda x: (x[1], x[2], x[0]))
