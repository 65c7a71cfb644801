"""Repetition coverage, decontamination, language and pseudo-likelihood against plain versions."""
import random
from collections import Counter

import numpy as np

from dawnscore.llm import decontaminate, language, pseudo_likelihood
from dawnscore.llm.repetition import SYMBOLS, repetition

from .cases import ODD, frame, prose, words


def covered(found, n):
    count = Counter(tuple(found[k:k + n]) for k in range(len(found) - n + 1))
    mark = [False] * len(found)
    for k in range(len(found) - n + 1):
        if count[tuple(found[k:k + n])] > 1:
            mark[k:k + n] = [True] * n
    return mark


def facts(text):
    found = [w.decode() for w in (text or "").encode().split()]
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        lines += line in seen and bool(line.encode().strip())
        seen.add(line)
    out = [len(found), sum(map(len, found)), sum(c in SYMBOLS for c in text or ""), lines, sum(covered(found, 3))]
    return out + [sum(len(w) for w, m in zip(found, covered(found, n)) if m) for n in range(5, 11)]


def test_repetition_equals_brute_force(spark):
    line = prose(4, 12)
    rows = ODD + [(1, (line + "\n") * 9), (2, prose(5, 40) + "\n" + line + "\n" + prose(6, 40) + "\n" + line),
                  (3, "a " * 400), (4, "# " * 30 + "a|b <c> " + prose(7)), (5, " ".join(words(8, 60) * 3)),
                  (6, "x\n\n\nx\n \n \ny")]
    got = repetition(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    for r in got:
        want = facts(texts[r.doc_id])
        have = [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words]
        assert have + [r[f"covered_{n}"] for n in range(5, 11)] == want
    verdict = {r.doc_id: r.repeats for r in got}
    assert verdict[1] and verdict[3] and verdict[5]
    assert not any(verdict[k] for k in (2, 4, 101, 102, 103, 106, None))
    assert repetition(frame(spark, [])).count() == 0


def test_coverage_decides_where_the_base_rule_passes(spark):
    def texts(n, seed):
        return prose(seed, 44) + "\n" + prose(seed + 1, n) + " " + prose(seed + 2, 44) + "\n" + prose(seed + 1, n)
    rows = [(1, texts(20, 1000)), (2, texts(30, 1010)), (3, texts(40, 1020)), (4, texts(8, 1030)),
            (5, prose(1040, 70) + ("\n" + prose(1041, 4)) * 6)]     # short lines, no n-gram inside one
    got = {r.doc_id: r for r in repetition(frame(spark, rows)).collect()}
    assert all(r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words for r in got.values())
    assert [got[k].repeats for k in range(1, 6)] == [True, True, True, False, True]


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks_equal_brute_force(spark, ):
    tests = [(k, f"{prose(300 + k, 30)}? The answer {prose(400 + k, 8)}.") for k in range(30)]
    tests += [(90, None), (91, ""), (92, "one sentence only " + prose(500, 20)), (93, prose(501, 30) + "\n" + prose(502, 5))]
    docs = [(k, prose(600 + k, 200) + " " + tests[k][1] + " " + prose(700 + k, 150)) for k in range(10)]
    docs += [(20, prose(620, 100) + " " + tests[3][1].upper().replace(" ", "\n") + " !"),
             (21, " ".join(tests[5][1].split()[:6]) + " " + prose(621, 300)),      # a few words only
             (22, tests[7][1].split("?")[0] + " " + prose(622, 90)),               # the whole question
             (23, tests[32][1]), (24, prose(624, 70) + " " + tests[33][1].replace("\n", " ")),
             (25, tests[1][1] + " " + prose(625, 500) + " " + tests[2][1])] + ODD
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, docs), items_of(spark, tests)).collect()}

    def share(wanted, text):
        n = min(5, len(wanted))
        grams = {tuple(wanted[k:k + n]) for k in range(len(wanted) - n + 1)}
        have = {tuple(text[k:k + n]) for k in range(len(text) - n + 1)}
        return len(grams & have) / len(grams)
    want = set()
    for i, text in docs:
        body = decontaminate.cores(text)
        for item, it in tests:
            q, a = decontaminate.question_answer(it)
            if q:
                x, y = share(q, body), share(a or q, body)
                if (x >= 0.5 and y >= 0.5) or x >= 0.8:
                    want.add((i, item))
    assert got == want
    parted = decontaminate.leaks(frame(spark, docs), items_of(spark, tests), part_items=7).collect()
    assert {(r.doc_id, r.item_id) for r in parted} == want
    assert decontaminate.leaks(frame(spark, docs), items_of(spark, [])).count() == 0
    assert decontaminate.leaks(frame(spark, []), items_of(spark, tests)).count() == 0


def test_question_alone_is_a_leak_whatever_the_answer_weighs(spark):
    tests = [(k, f"{prose(1300 + k, 6)}? {prose(1400 + k, 40)}.") for k in range(6)]
    tests += [(9, "so so so so so so so so so so rare9 ? " + prose(1409, 30) + ".")]
    question, answer = zip(*(t.split("? ") for _, t in tests))
    docs = [(k, prose(1500 + k, 80) + " " + question[k] + " " + prose(1600 + k, 80)) for k in range(7)]
    half = " ".join(question[1].split()[:5])     # one n-gram of two: no leak beside a whole answer below 0.5
    docs += [(10, question[0] + " " + prose(1700, 400) + " " + answer[0]),
             (11, answer[0] + " " + prose(1701, 400) + " " + question[0]),
             (12, half + " " + prose(1702, 300)), (13, answer[2] + " " + prose(1703, 300))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, docs), items_of(spark, tests)).collect()}
    assert got == {(k, tests[k][0]) for k in range(7)} | {(10, 0), (11, 0)}


def test_every_passage_that_meets_the_rule_is_retrieved():
    rng = np.random.default_rng(8)
    items = [(k, f"{prose(1800 + k, int(rng.integers(5, 30)))}? {prose(1900 + k, int(rng.integers(2, 30)))}.") for k in range(40)]
    items += [(50 + k, "a b c d e f g h i j k l m n. " + prose(2000 + k, 9) + ".") for k in range(20)]
    df = Counter(w for _, t in items for w in set(decontaminate.cores(t)))
    index = decontaminate.build_index(items, df, len(items), 25.0, 0.5)
    texts = []
    for _, t in items:
        q, a = decontaminate.question_answer(t)
        for part in (q[:max(5, -(-9 * len(q) // 10))], q[len(q) // 4:] + ["zz"] + a[:-(-3 * len(a) // 4)]):
            texts.append(" ".join(part + prose(2100 + len(texts), 20).split()))
    found = {(k, i): index.is_leak(q, a) for k, i, _, q, a in decontaminate.search(index, decontaminate._TermOf(index.terms), texts)}
    leaked = 0
    for k, text in enumerate(texts):
        ids = [index.terms.get(w, -1) for w in decontaminate.cores(text)]
        for i in range(len(items)):
            def share(wanted):
                n = len(next(iter(wanted)))
                return len(wanted & {tuple(ids[j:j + n]) for j in range(len(ids) - n + 1)}) / len(wanted)
            want = index.is_leak(share(index.question[i]), share(index.answer[i]))
            leaked += want
            assert want == found.get((k, i), False)
    assert leaked > 60


def test_block_bounds_never_hide_an_item():
    items = [(k, prose(800 + k, 40)) for k in range(60)]
    df = Counter(w for _, t in items for w in set(decontaminate.cores(t)))
    index = decontaminate.build_index(items, df, len(items), 40.0, 0.4)
    texts = [prose(900 + k, 30) + " " + " ".join(items[k][1].split()[:5 + k % 36]) for k in range(60)]
    found = {(k, i) for k, i, *_ in decontaminate.search(index, decontaminate._TermOf(index.terms), texts)}
    for k, text in enumerate(texts):
        ids = {index.terms.get(w, -1) for w in decontaminate.cores(text)}
        for i in range(len(items)):
            full = sum(w for t, w in zip(index.item_terms[i], index.item_weights[i]) if t in ids)
            assert ((k, i) in found) == (full >= 0.4 - 1e-9)


def test_language(spark):
    kinds = {"xx": "abcde", "yy": "vwxyz", "zz": "klmno"}
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        lang = list(kinds)[k % 3]
        text = " ".join("".join(rng.choice(list(kinds[lang] + "t"), 5)) for _ in range(20))
        rows.append((k, text, lang, "s"))
    odd = [(900, None, "xx", "s"), (901, "12 34 ..", "xx", "s"), (902, "", None, "s"), (None, rows[0][1], "xx", "s"), (903, "中文", None, "s")]
    got = {r.doc_id: r for r in language.predict(frame(spark, rows + odd)).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert held and sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred == "xx"
    import zlib
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got if k is not None)
    none = language.predict(frame(spark, [(1, "words", None, "s"), (2, None, None, None)])).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language.predict(frame(spark, [])).count() == 0


def test_presence_is_of_whole_texts():
    long = "a" * 30_000 + "qz"
    alone = language.presence(["qz"])[0]
    assert (language.presence([long])[0] & alone).sum() == alone.sum()
    a, b = prose(1), prose(2)
    both = language.presence([a, b])
    assert (both[0] == language.presence([a])[0]).all() and (both[1] == language.presence([b])[0]).all()


def test_pseudo_likelihood(spark):
    pattern = "one two three four five six seven eight"
    rows = [(k, " ".join([pattern] * 40)) for k in range(40)] + [(200, " ".join(reversed((pattern + " ") .split() * 40)))] + ODD
    got = {r.doc_id: r for r in pseudo_likelihood.score(frame(spark, rows)).collect()}
    assert got[0].n_words == 320 and got[0].log_prob == got[1].log_prob
    assert got[0].mean_log_prob > got[105].mean_log_prob       # learned text against rare words
    assert abs(got[0].log_prob - 320 * got[0].mean_log_prob) < 1e-6
    assert got[101].n_words == 0 and got[101].log_prob == 0 and got[101].mean_log_prob is None
    assert pseudo_likelihood.score(frame(spark, [])).count() == 0


def test_rounds_train_on_every_window_once(spark):
    ids = [np.arange(n, dtype=np.uint16) for n in (0, 1, 5, 2, 0, 33, 1)]
    _, places = pseudo_likelihood.windows(ids)
    turns = [pseudo_likelihood.round_places(ids, places, k) for k in range(pseudo_likelihood.ROUNDS)]
    assert sorted(np.concatenate(turns).tolist()) == places.tolist()
    # seven words a text, all different: a text without a window of its own would stay as unlikely as before training
    rows = [(k, " ".join(f"d{k}w{j}" for j in range(7))) for k in range(60)]
    source = frame(spark, rows).select("doc_id", "text")
    tokens = pseudo_likelihood.token_ids(source, pseudo_likelihood.vocabulary(source)).coalesce(1)
    before, after = (pseudo_likelihood.Network.from_flat(x) for x in (pseudo_likelihood.initial(), pseudo_likelihood.fit(tokens)))
    flat, places = pseudo_likelihood.windows([np.frombuffer(r.ids, np.uint16) for r in tokens.collect()])
    around = pseudo_likelihood._around(flat, places)
    gain = after.log_probs(around, flat[places]) - before.log_probs(around, flat[places])
    assert (gain > 0).mean() > 0.95


def test_network_probabilities_add_up():
    net = pseudo_likelihood.Network.from_flat(pseudo_likelihood.initial())
    around = np.array([[1, 2, 3, 4]] * pseudo_likelihood.VOCABULARY)
    logs = net.log_probs(around, np.arange(pseudo_likelihood.VOCABULARY))
    assert abs(np.exp(logs.astype(float)).sum() - 1) < 1e-4
    rng = np.random.default_rng(1)
    around, target = rng.integers(0, 50, (256, 4)), rng.integers(0, 50, 256)
    before = net.log_probs(around, target).mean()
    for _ in range(5):
        net.train(around, target)
    assert net.log_probs(around, target).mean() > before + 1


def plain_log_prob(net, ids):
    """Sum of log-probabilities of a text's words, one word and one place of the window at a time."""
    total = 0.0
    for at, word in enumerate(ids):
        h = np.array(net.bias, float)
        for k, d in enumerate([-2, -1, 1, 2]):
            other = ids[at + d] if 0 <= at + d < len(ids) else pseudo_likelihood.PAD
            h += net.near[k][other]
        h /= 1 + np.abs(h)
        size = pseudo_likelihood.CLASS
        over = np.array([h @ net.classes[c] + net.class_bias[c] for c in range(size)])
        inside = np.array([h @ net.members[word // size][m] + net.member_bias[word // size][m] for m in range(size)])
        total += over[word // size] - np.log(np.exp(over).sum()) + inside[word % size] - np.log(np.exp(inside).sum())
    return total


def test_scores_equal_a_plain_network_and_any_cut(spark):
    rows = [(k, prose(3000 + k, 60)) for k in range(50)] + [(60, prose(9, 3000))]
    df = frame(spark, rows)
    got = {r.doc_id: r.log_prob for r in pseudo_likelihood.score(df.repartition(4)).collect()}
    again = {r.doc_id: r.log_prob for r in pseudo_likelihood.score(df.repartition(32)).collect()}
    assert got == again
    source = df.select("doc_id", "text")
    tokens = pseudo_likelihood.token_ids(source, pseudo_likelihood.vocabulary(source))
    net = pseudo_likelihood.Network.from_flat(pseudo_likelihood.fit(tokens))
    for r in tokens.filter("doc_id < 5").collect():
        assert abs(plain_log_prob(net, np.frombuffer(r.ids, np.uint16).tolist()) - got[r.doc_id]) < 1e-2


def test_shares_are_averaged_by_their_windows(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "SHARE_WORDS", 500)
    df = frame(spark, [(k, prose(4000 + k, 90)) for k in range(40)]).select("doc_id", "text")
    tokens = pseudo_likelihood.token_ids(df, pseudo_likelihood.vocabulary(df))
    one = pseudo_likelihood.fit(tokens.repartition(3))
    assert np.array_equal(one, pseudo_likelihood.fit(tokens.repartition(11)))
    assert np.isfinite(one).all() and not np.array_equal(one, pseudo_likelihood.initial())


def test_language_of_long_texts(spark):
    """Texts of great variety and any length, beside learned texts of 120 words."""
    letters = {"aa": "aeioulnrst", "bb": "aeioukmvzj"}

    def prose(lang, words, seed):
        rnd = random.Random(f"{lang}{seed}")
        return " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randint(3, 9))) for _ in range(words))
    rows = [(k, prose(lang, 120, k), lang, "s") for k in range(1, 121) for lang in [("aa", "bb")[k % 2]]]
    asked = {5_000 + n: (lang, size) for n, (lang, size) in enumerate(
        (lang, size) for size in (100, 1_000, 5_000, 20_000) for lang in ("aa", "bb"))}
    rows += [(i, prose(lang, size, i), None, "s") for i, (lang, size) in asked.items()]
    got = {r.doc_id: r.lang_pred for r in language.predict(frame(spark, rows)).collect()}
    assert {i: got[i] for i in asked} == {i: lang for i, (lang, _) in asked.items()}


def test_text_kernel_is_the_mean_over_windows():
    texts = ["ab cd " * 3, "xyz " * 1_500, "42 " * 900 + "ab cd ef " * 400]
    bits = np.packbits(language.presence([language.training_window(t, k) for k, t in enumerate(texts)]), axis=1)
    model = language.fit(["p", "q", "p"], bits, ["p", "q"])
    got = language.text_scores(model, texts)
    for k, text in enumerate(texts):
        parts = [w for w in language.windows(text) if language.has_letter(w)]
        want = sum(len(w) * model.scores(language.presence([w]))[0] for w in parts) / sum(map(len, parts))
        assert np.allclose(got[k], want, atol=1e-5)
        grams = {text[i:i + 4] for i in range(len(text) - 3)}
        assert grams == {w[i:i + 4] for w in language.windows(text) for i in range(len(w) - 3)}
