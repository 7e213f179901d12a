"""The operators' cores against plain brute force, without Spark."""

import itertools
import pickle
import random

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import decontaminate, html, language, media, near_dedup, order, packing, shard, substring_dedup, tokens


def test_windows_and_scan_match_brute_force():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice(["ab ", "Cd-", "é ", "x9", "\n", "no "]) for _ in range(n))
    items = {i: text(rng.randint(0, 14)) for i in range(20)}
    block = {}
    for i, t in items.items():
        for p in decontaminate.windows(t, 3):
            block.setdefault(p, []).append(str(i))
    auto = decontaminate.automaton(block)
    for _ in range(60):
        t = text(30)
        w = decontaminate.words(t)
        n, hits = decontaminate.scan(t.encode(), auto)
        want = set()
        for i, item in items.items():
            own = decontaminate.words(item)
            k = min(3, len(own))
            for a in range(len(own) - k + 1 if k else 0):
                want |= {(j, j + k - 1, str(i)) for j in range(len(w) - k + 1) if w[j : j + k] == own[a : a + k]}
        assert n == len(w) and set(hits) == want
        n_hit, ids, spans = decontaminate.resolve(t.encode(), hits)
        assert n_hit == len({k for a, b, _ in want for k in range(a, b + 1)})
        covered = [x for a, b in spans for x in decontaminate.words(t[a:b])]
        assert len(covered) == n_hit and ids == sorted({i for *_, i in want})


def test_each_block_is_scanned_with_its_own_automaton():
    """Blocks that come and go in one worker, as broadcasts do, and may get one another's address."""

    class Sent:
        def __init__(self, raw):
            self.value = pickle.loads(raw)

    raw = [pickle.dumps((f"block {k}", {w: ["i"] for w in decontaminate.windows(f"word{k} is here", 3)})) for k in range(40)]
    for k, block in enumerate(raw):
        run = decontaminate._scanner(Sent(block), True)
        found = next(run(iter([(pa.array([f"a word{k} is here"]), pa.nulls(1, pa.list_(pa.int64())))])))
        assert found[0].as_py()["n_hit"] == 3
        assert next(decontaminate._clean(Sent(block))(iter([(pa.array([f"a word{k} is here", "word is here", None]),)]))).to_pylist() == [False, True, True]
        del run


def test_repeated_windows_match_brute_force():
    rng = random.Random(2)
    strings = [[rng.choice([b"a", b"b", b"cc"]) for _ in range(rng.randint(4, 9))] for _ in range(200)]
    size = np.array([len(s) for s in strings])
    got = substring_dedup.repeated(b" ".join(w for s in strings for w in s), size, np.zeros(len(size), np.uint8), 4)
    windows = [tuple(s[i : i + 4]) for s in strings for i in range(len(s) - 3)]
    assert got.tolist() == [windows.count(w) > 1 for w in windows]


def test_folded_strings_settle_every_copy(monkeypatch):
    """A bucket of many blobs, folded whenever it holds anything, against one that is not folded."""
    rng = random.Random(6)
    pool = [b" ".join(rng.choice([b"a", b"b"]) for _ in range(6)) for _ in range(9)]
    rows, want = [], {}
    for k in range(60):
        strings = [rng.choice(pool) for _ in range(rng.randint(1, 4))]
        keys = np.array([bytes([k, i]) + bytes(14) for i in range(len(strings))], "V16")
        rows.append(substring_dedup._dump(keys, np.zeros(len(strings), np.int64), np.full(len(strings), 6), np.zeros(len(strings), bool), strings))
    batch = pa.RecordBatch.from_arrays([pa.array([3] * 60, pa.int32()), pa.array([False] * 60), pa.nulls(60, pa.binary()), pa.array(rows, pa.binary())], names=["bucket", "settled", "key", "payload"])

    def ranges():
        out = {}
        for got in substring_dedup._counter(4, 5)(iter([batch])):
            for v in got.column(2):
                pairs = np.frombuffer(v.as_py()[16:], np.int32).reshape(-1, 2)
                out.setdefault(v.as_py()[:16], set()).update(x for a, b in pairs for x in range(a, b))
        return out

    want = ranges()
    monkeypatch.setattr(substring_dedup, "HELD_BYTES", 100)
    assert ranges() == want and want


def test_superkmers_cover_each_window_once():
    text = b" ".join(b"w%d" % (i * i % 13) for i in range(90))
    edge = np.array([0, 20, 23, 90])
    h = substring_dedup.word_hashes(text, *substring_dedup.word_bounds(text))
    first, size, _ = substring_dedup.superkmers(h, edge, 6, 3, np.zeros(0, np.uint64))
    seen = sorted(f + i for f, s in zip(first.tolist(), size.tolist()) for i in range(s - 5))
    assert seen == [w for a, b in zip(edge[:-1], edge[1:]) for w in range(a, b - 5)]


def test_treap_is_best_fit():
    rng = random.Random(3)
    hist = {}
    for _ in range(400):
        s = rng.randint(1, 60)
        hist[s] = hist.get(s, 0) + 1
    plan = shard.best_fit(list(hist.items()), 100)
    room, bins = [], []
    for s in sorted((s for s, c in hist.items() for _ in range(c)), reverse=True):
        fits = [(r, b) for b, r in enumerate(room) if r >= s]
        b = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(100)
        room[b] -= s
        bins.append((s, b))
    got = [(s, b) for s, a, e, b in plan for _ in range(e - a)]
    load = lambda x: sorted(sum(s for s, c in x if c == b) for b in {c for _, c in x})
    assert load(got) == load(bins)


def test_plan_packs_every_piece_once_with_little_padding():
    rng = random.Random(4)
    hist = {}
    for _ in range(3000):
        s = rng.choice((rng.randint(1, 1023), 700))
        hist[s] = hist.get(s, 0) + 1
    segments, windows = packing.plan(hist)
    used, place = {}, {}
    for c, a, b, s, n, w, off, _ in segments:
        for k in range(a, b):
            used.setdefault((c, k), []).append((s, n))
            place.setdefault(w + k - a, []).append((off, n))
    assert len(used) == sum(hist.values()) and sorted(place) == list(range(windows))
    for (c, _), parts in used.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == c
    pad = 0
    for parts in place.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 1024
        pad += 0 if at & (at - 1) == 0 else 1024 - at
    assert pad < 0.01 * 1024 * windows


@pytest.mark.parametrize("size", [1, 2, 3, 10, 1000])
def test_feistel_is_a_permutation(size):
    f = order.Feistel(size, b"k")
    image = [f(i) for i in range(size)]
    assert sorted(image) == list(range(size)) and [f.back(x) for x in image] == list(range(size))
    assert f.many(np.arange(size)).tolist() == image


def test_media_round_trip():
    for raw in (b"", b"a", bytes(range(256)) * 3, "é".encode() * 1000):
        data = media.payload(raw)
        png = media.encode(data)
        assert len(data) % 64 == 0 and data and media.decode(png) == data and data.rstrip(b"\0") == raw.rstrip(b"\0")
        assert media.header(png[: media.HEADER_BYTES]) == (64, len(data) // 64, 8)


def test_fast_ids_equal_the_tokenizer():
    encode = tokens.encoder(tokens.default_path())
    for t in ("", " ", "a\n\n b  c", "naïve café 12345 don't  \t x", "<|endoftext|> x", "日本語 😀", "a" * 3000):
        assert encode(t).tolist() == encode.slow.encode(t, add_special_tokens=False).ids


def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        counts = rng.integers(0, 6, 4)
        scores = (rng.normal(size=(counts.sum(), 3)) * 3).astype(np.float32)
        got, at = language.viterbi(scores, counts, 2.0), 0
        for c in counts.tolist():
            if c:
                paths = itertools.product(range(3), repeat=c)
                best = max(paths, key=lambda z: sum(scores[at + i, z[i]] for i in range(c)) - 2 * sum(z[i] != z[i - 1] for i in range(1, c)))
                assert tuple(got[at : at + c]) == best
            at += c


def test_samples_agree_with_weighted_jaccard():
    rng = np.random.default_rng(5)
    h = np.sort(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    w = rng.uniform(1, 3, 400)
    a, b = slice(0, 340), slice(60, 400)
    s = [near_dedup.samples(np.zeros(340, np.int64), h[x], w[x], 600)[0] for x in (a, b)]
    assert abs((s[0] == s[1]).mean() - near_dedup.similarity((h[a], w[a]), (h[b], w[b]))) < 0.08


def test_profiles_keep_similar_texts_and_rule_out_families():
    word = [f"w{k * 7919 % 100003}" for k in range(3000)]
    texts = [" ".join(word[a : a + 500]).encode() for a in (0, 30, 250)] + [("one two three four five six seven " * 60).encode()]
    profile = near_dedup.profiles(*near_dedup.shingles(texts))
    assert not profile[3].any() and profile[:3].any(1).all()
    kept = near_dedup.may_agree(profile[0], profile, near_dedup.SIMILARITY - near_dedup.PROFILE_SLACK)
    assert kept.tolist() == [True, True, False, True]


def test_main_text_of_pages():
    model = html.train()
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">buy</div><article><h1>Head &amp; line</h1><p><b>One  two.<br>three</p><p>Four\n five.</article><footer>&copy; x</footer>'
    assert html.texts([page, None, ""], model) == ["Head & line\n\nOne two. three\n\nFour five.", "", ""]
    layouts, wrong, total = html.Layouts(99), 0, 0
    for _ in range(60):
        truth = []
        p = html.parse(layouts.page(), truth)
        truth = [False, *truth]
        x, direct = html.features(p)
        kept = html.decode(p, model.log_odds(x), direct)
        wrong += sum(len(b) for b, o in zip(p.blocks, p.owner) if kept[o] != truth[o])
        total += sum(map(len, p.blocks))
        for k, node in enumerate(p.nodes):  # no kept node below a dropped one that lies in a kept one
            if kept[k] and node.parent >= 0 and not kept[node.parent]:
                up = node.parent
                while up >= 0:
                    assert not kept[up]
                    up = p.nodes[up].parent
    assert wrong < 0.05 * total


def test_pages_that_look_broken():
    model, p = html.train(), "<p>A paragraph with some words, and more.</p>"
    text = "A paragraph with some words, and more."
    page = f"<script>if(a<b){{ // don't }}</script><article>{p}<p>It's...</p>{p}</article>"
    assert html.texts([page], model) == [f"{text}\n\nIt's...\n\n{text}"]
    assert html.texts(['<article><p class=x">Hello</p><p>mid</p><p class=y">Other</p></article>'], model) == ["Hello\n\nmid\n\nOther"]
    assert html.texts([f"<article>{p}<script>var c = '<!-- ';</script>{p}</article>"], model) == [f"{text}\n\n{text}"]
    inside = "<p>One <math><mi>x</mi></math> <xmp>a &amp; <b></xmp> <object>two</object>, and so on.</p>"
    assert html.texts([f"<article>{p}{inside}{p}</article>"], model) == [f"{text}\n\nOne x a &amp; <b> two, and so on.\n\n{text}"]
    assert html.texts([f"<head><script>s = '</head>'</script><article>{p}{p}</article>"], model) == [f"{text}\n\n{text}"]
    wide = "\u0130" * 50
    assert html.texts([f"<article><p>{wide} {text}</p><style>p {{}}</style>{p}</article>"], model) == [f"{wide} {text}\n\n{text}"]


def _plain_tokens(h):
    """The standard's states, character by character, with the reader's rules for what nothing closes."""
    space, out, data, i, n = "\t\n\f\r ", [], [], 0, len(h)

    def flush():
        if data:
            out.append(("text", "".join(data), ""))
            data.clear()

    def tag(i):
        """(name, attributes, after) of a tag whose name starts at i, or None at the end of the page."""
        a = i
        while i < n and h[i] not in space + "/>":
            i += 1
        name, b, state = h[a:i].lower(), i, "before"
        while i < n:
            c = h[i]
            if state in ("dq", "sq"):
                state = "before" if c == ('"' if state == "dq" else "'") else state
            elif c == ">":
                return name, h[b:i], i + 1
            elif state == "before":
                state = "before" if c in space + "/" else "name"
            elif state == "name":
                state = "before" if c == "/" else "after" if c in space else "value" if c == "=" else "name"
            elif state == "after":
                state = "after" if c in space else "before" if c == "/" else "value" if c == "=" else "name"
            elif state == "value":
                if c not in space:
                    state = "unquoted"
                    if c in "\"'":
                        closes = c in h[i + 1 :]
                        state = ("dq" if c == '"' else "sq") if closes else "name"
            elif state == "unquoted" and c in space:
                state = "before"
            i += 1
        return None

    def ends(name, i):
        low = h.lower()
        while (i := low.find("</" + name, i)) >= 0:
            if i + 2 + len(name) < n and h[i + 2 + len(name)] in space + "/>":
                return i
            i += 1
        return -1

    while i < n:
        if h[i] != "<" or i + 1 == n:
            data.append(h[i])
            i += 1
        elif h[i + 1].isalpha():
            flush()
            if (got := tag(i + 1)) is None:
                return out
            name, more, i = got
            out.append(("open", name, more))
            if name in ("style", "title") and not (more.endswith("/") and (more == "/" or more[-2] in space + "\"'")):
                end = ends(name, i)
                end = n if end < 0 and name == "style" else end
                if end >= 0:
                    out.append(("raw", name, h[i:end]))
                    i = end
        elif h[i + 1] == "/" and i + 2 < n and h[i + 2].isalpha():
            flush()
            if (got := tag(i + 2)) is None:
                return out
            out.append(("close", got[0], ""))
            i = got[2]
        elif h[i + 1] == "!" or (h[i + 1] == "/" and i + 2 < n):
            flush()
            if h.startswith("<!--", i) and not h.startswith((">", "->"), i + 4):
                at = [x for x in (h.find("-->", i + 4), h.find("--!>", i + 4)) if x >= 0]
                if not at:
                    return out
                i = h.index(">", min(at)) + 1
            elif ">" in h[i:]:
                i = h.index(">", i) + 1
            else:
                return out
        else:
            data.append(h[i])
            i += 1
    flush()
    return out


def test_tokens_match_the_states_of_the_standard():
    rng = random.Random(8)
    parts = ["<", "</", ">", "/", "!", "<!--", "-->", "-", '"', "'", "=", " ", "\n", "p", "b", "style", "title", "<p", "<style>", "</style>", "</STYLE >", "<title a='1>2'>", "</title", "class=", "x"]
    for _ in range(20_000):
        h = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert list(html.tokens(h)) == _plain_tokens(h), h
