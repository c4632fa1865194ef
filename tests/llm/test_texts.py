"""Evaluation leaks, mixing and garbled text."""

from __future__ import annotations

import random
import re

import pandas as pd
import pytest

from larkspur.llm import garbled_text as gt
from larkspur.llm.eval_leaks import Leaks, eval_leaks
from larkspur.llm.mixing import Mixture, solve_plan, token_counts, default_tokenizer


def leak_model(items, docs, n):
    def split(t):
        import regex

        return [w.casefold() for w in regex.findall(r"[\p{L}\p{N}]+", t)]

    grams = {}
    for i, t in items:
        if t is not None and i is not None:
            w = split(t)
            for k in range(len(w) - n + 1):
                grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        if t is not None and d is not None:
            w = split(t)
            for k in range(len(w) - n + 1):
                out |= {(i, d) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


@pytest.mark.parametrize("n", [1, 2, 5, 12])
def test_leaks_match_brute_force(spark, n):
    rng = random.Random(n)
    word = lambda: rng.choice(["a", "b", "c", "Größe", "GRÖSSE", "x1"])
    text = lambda size: "".join(word() + rng.choice([" ", " - ", "<br>", "…"]) for _ in range(size))
    items = [(k, text(rng.randrange(25))) for k in range(12)] + [(50, None), (None, text(20)), (51, ""), (0, text(20))]
    docs = [(k, text(rng.randrange(60))) for k in range(40)] + [(90, None), (91, "a " * 50_000), (92, ""), (None, items[0][1])]
    docs += [(93 + k, f"zz {t} zz") for k, (_, t) in enumerate(items) if t]
    corpus = spark.createDataFrame([(*d, 1, "s") for d in docs + docs[:3]], "doc_id long, text string, item_id int, start string")
    tests = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")
    for chars, held in ((16_000_000, 1), (200, 1), (200, 10_000_000)):
        got = eval_leaks(corpus, tests, min_words=n, automaton_chars=chars, held_chars=held).collect()
        assert {(r.item_id, r.doc_id) for r in got} == leak_model(items, docs, n)
        assert len(got) == len(set(got))
        assert all(r.n_words >= n for r in got)
    assert eval_leaks(corpus.limit(0), tests).collect() == []
    assert eval_leaks(corpus, tests.limit(0)).collect() == []


def test_offsets_are_of_the_original_text():
    text = "Intro – ONE, two;\n<b>three</b> FOUR five six outro"
    found = list(Leaks([(7, "zero one two three b four five six")], 3).find(text.replace("<b>three</b>", "Three (b)")))
    own = text.replace("<b>three</b>", "Three (b)")
    assert [(i, n, own[a:b]) for i, n, a, b in found] == [(7, 7, own[own.index("ONE") : own.index(" outro")])]


def test_a_block_of_many_items():
    rng = random.Random(0)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    items = [(k, f"{text(rng.randrange(13))} one two three four five six {text(rng.randrange(13))}") for k in range(200)]
    docs = [(k, f"{text(5)} {' '.join(items[k][1].split()[rng.randrange(8) :])} {text(5)}") for k in range(100)] + [(200, "one two three four five six")]
    for n in (1, 2, 7, 12):
        few, many = Leaks(items, n, many=0), Leaks(items, n, many=1000)
        got = {(i, d) for d, t in docs for i, *_ in few.find(t)}
        assert got == {(i, d) for d, t in docs for i, *_ in many.find(t)} == leak_model(items, docs, n)


def plan(rows):
    return pd.DataFrame(rows, columns=["plan_id", "source", "weight", "max_repeats", "supply"])


def test_plan_is_as_long_as_the_caps_allow():
    got = solve_plan(plan([(1, "a", 1, 2, 100), (1, "b", 3, None, 50), (1, "c", 4, 1, 0)]), None, 0.5)
    assert got["demand"].tolist() == [200, 600, 0]
    assert got["share"].tolist() == [0.25, 0.75, 0]
    assert got["target_share"].tolist() == [0.125, 0.375, 0.5]
    assert (got["share"] * got["slope"]).sum() == pytest.approx(0)
    assert (got["slope"].abs() <= 0.5).all()


def test_plan_of_given_length_passes_on_what_a_cap_leaves():
    got = solve_plan(plan([(1, "a", 1, 1, 100), (1, "b", 1, None, 50), (1, "c", 2, None, 999)]), 1000, 0.5)
    assert got["demand"].tolist() == pytest.approx([100, 300, 600])
    assert solve_plan(plan([(1, "a", 1, 1, 100)]), 1000, 0.5)["demand"].tolist() == [100]
    assert solve_plan(plan([(1, "a", 1, 0, 100)]), None, 0.5)["demand"].tolist() == [0]


def test_mixture(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(["word"] * rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(900)]
    docs += [(1000, None, "a"), (1001, "", "a"), (None, "x", "a"), docs[0], (1002, "long " * 3000, "z")]
    targets = [(1, "a", 0.5, 1), (1, "b", 0.4, 4), (1, "gone", 0.1, 2), (2, "c", 2.0, None), (2, "b", 1.0, None), (2, None, 1.0, 1), (3, "a", 0.0, 1), (2, "c", 2.0, None)]
    frames = (
        spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, copy int, offset int"),
        spark.createDataFrame(targets, "plan_id long, source string, weight double, max_repeats int"),
    )
    mixture = Mixture(*frames)
    used = mixture.documents().toPandas()
    assert (used.groupby(["plan_id", "doc_id", "copy"]).size() == 1).all()
    assert not used.duplicated(["plan_id", "doc_id", "copy"]).any()
    shares = {(r.plan_id, r.source): r for r in mixture.shares().collect()}
    assert set(shares) == {(1, "a"), (1, "b"), (1, "gone"), (2, "c"), (2, "b")}
    assert shares[1, "gone"].tokens == 0
    assert shares[1, "a"].actual_share == pytest.approx(5 / 9, abs=0.01)
    assert shares[2, "c"].actual_share == pytest.approx(2 / 3, abs=0.01)
    caps = {"a": 1, "b": 4}
    assert all((g["copy"].max() + 1) <= caps[s] for (p, s), g in used[used.plan_id == 1].groupby(["plan_id", "source"]))
    # Sources that repeat more come later, and any stretch holds about the scheduled weights.
    one = used[used.plan_id == 1].sort_values("position")
    b = one[one.source == "b"]
    assert b["position"].mean() > one[one.source == "a"]["position"].mean()
    assert one["position"].is_monotonic_increasing and one["position"].between(0, one["n_tokens"].sum() * 1.01).all()
    empty = Mixture(frames[0].limit(0), frames[1])
    assert empty.documents().collect() == [] and all(r.tokens == 0 for r in empty.shares().collect())
    assert Mixture(frames[0], frames[1].limit(0)).documents().collect() == []


def test_mixture_follows_a_given_schedule(spark):
    docs = [(k, "word " * 10, "abc"[k % 3]) for k in range(3000)]
    frames = (
        spark.createDataFrame(docs, "doc_id long, text string, source string"),
        spark.createDataFrame([(1, "a", 1.0, 9), (1, "b", 1.0, 9), (1, "c", 1.0, 9), (2, "a", 1.0, 1)], "plan_id long, source string, weight double, max_repeats int"),
    )
    knots = [(1, "a", 0.0, 2.0), (1, "a", 0.5, 0.0), (1, "b", 0.0, 2.0), (1, "b", 1.0, 2.0), (1, "c", 0.5, 0.0), (1, "c", 1.0, 6.0), (1, "c", 3.0, 9.0), (1, None, 0.0, 1.0)]
    schedule = spark.createDataFrame([*knots, (7, "a", 0.0, 1.0)], "plan_id long, source string, time double, weight double")
    mixture = Mixture(*frames, schedule=schedule)
    shares = {(r.plan_id, r.source): r for r in mixture.shares().collect()}
    # a falls from 1/2 to 0 by half-time, b rises from 1/2 to 1 and falls to 1/4, c rises from 0 to 3/4 then.
    for source, share in (("a", 0.125), ("b", 0.6875), ("c", 0.1875)):
        assert shares[1, source].target_share == pytest.approx(share) and shares[1, source].actual_share == pytest.approx(share, abs=0.002)
    assert shares[2, "a"].actual_share == 1 and len(shares) == 4
    used = mixture.documents().toPandas()
    one = used[used.plan_id == 1]
    time = one["position"] / one["n_tokens"].sum()
    for begin in (0.0, 0.3, 0.6, 0.9):
        stretch = one[(time >= begin) & (time < begin + 0.1)]
        middle = begin + 0.05
        rate = {"a": max(0, 0.5 - middle), "b": 0.5 + middle if middle < 0.5 else 1 - 1.5 * (middle - 0.5), "c": max(0, 1.5 * (middle - 0.5))}
        for source in "abc":
            own = stretch[stretch.source == source]["n_tokens"].sum() / stretch["n_tokens"].sum()
            assert own == pytest.approx(rate[source], abs=0.02), (begin, source)


def test_token_counts_are_the_tokenizers(spark):
    import base64

    import tiktoken

    with open(default_tokenizer(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import public_tokenizers

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Don't stop — größer 123 <|endoftext|>", "  \n\n x", "日本語", "we'll they're I'd"]
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_tokens for r in token_counts(frame, default_tokenizer()).collect()} == {i: len(own.encode_ordinary(t)) for i, t in enumerate(texts)}


CLEAN = [
    "L’équipe a publié une mise à jour élégante du système déjà testé.",
    "Die Prüfstände hören plötzlich auf, größere Einträge zu verschlüsseln.",
    "El pequeño módulo cambió después; ¿por qué todavía no? La migración terminó.",
    "Этот словарь сохраняет копию данных каждую ночь, если поиск работает.",
    "Zespół wreszcie znalazł błąd w części sieciowej, a pamięć działa świetnie.",
    "昨日の障害は検索の設定が原因でした。新しい版では辞書と端末が同時に更新されます。",
    "NÃO apague o sistema antes da CONCLUSÃO: ATENÇÃO às INFORMAÇÕES.",
    "It’s a café’s “naïve” cache — not free — and costs €20 a month…",
]
CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac-roman"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "gb18030"), ("cp1252", "utf-8")]


def garble(text, written, read):
    if (written, read) == ("utf-8", "cp1252"):
        return gt._decode(text.encode("utf-8"), "web-1252")
    return text.encode(written, "ignore").decode(read, "replace")


@pytest.fixture(scope="module")
def garbled(spark):
    rows, bad, at = [], {}, 0
    for _ in range(12):
        for text in CLEAN:
            rows.append((at, text))
            at += 1
    for written, read in CHAINS:
        for text in CLEAN:
            changed = garble(text, written, read)
            if changed != text and len(re.sub(r"[^\x00-\x7f]", "", text.encode(written, "ignore").decode(written))) < len(text.encode(written, "ignore").decode(written)):
                rows.append((at, f"Plain words first. {changed}"))
                bad[at] = (written, read, f"Plain words first. {text}")
                at += 1
    rows += [(at, None), (at + 1, ""), (None, "grÃ¶ÃŸer"), (at + 2, "Strings such as \"Ã©\" or “â€™” (it should read “’”) are known."), (at + 3, "é" * 30_000)]
    rows += [(at + 4, "├── src\n└── Σ over ∂x, √2 ≈ 1.414 at 6 °C 😀"), rows[0], (at + 5, "One wrong stretch only: wir prÃ¼fen größere Einträge.")]
    bad[at + 5] = ("utf-8", "cp1252", "One wrong stretch only: wir prüfen größere Einträge.")
    rows += [(at + 6 + k, "Ja, wir prüfen das.") for k in range(5)]
    frame = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, df int")
    return gt.GarbledText(frame), bad


def test_garbled_documents_are_found(garbled):
    operator, bad = garbled
    got = [r.doc_id for r in operator.found().collect()]
    assert sorted(got) == sorted(bad)


def test_garbled_documents_are_restored_where_nothing_was_lost(garbled):
    operator, bad = garbled
    got = {r.doc_id: r for r in operator.restored().collect()}
    assert sorted(got) == sorted(bad)
    lossless = lambda written, read, text: "\ufffd" not in garble(text, written, read) and text.encode(written, "ignore").decode(written) == text
    whole = [i for i, b in bad.items() if lossless(*b)]
    right = [i for i in whole if got[i].restored == bad[i][2]]
    assert len(whole) > 30 and len({bad[i][:2] for i in whole}) >= len(CHAINS) - 1
    assert len(right) >= 0.95 * len(whole), [(bad[i], got[i].restored) for i in whole if i not in right]


def test_garbled_words_between_quotation_marks(spark):
    clean = ["Если поиск работает, {}.", "Wir haben größere Einträge, {}.", "Nos vemos mañana, {}."]
    rows = [t.format(k) for k in range(6) for t in clean] + [f"Sie sagt „größere“ und meint «поиск», {k}." for k in range(3)]
    bad = [
        f"She wrote {a}{garble(word, 'utf-8', read)}{b} again, {i}."
        for i, word in enumerate(("поиск", "größere", "mañana"))
        for read in ("cp1252", "cp866", "cp437", "cp1251")
        for a, b in (("", ""), ('"', '"'), ("“", "”"), ("«", "»"))
    ]
    cites = ['Strings such as "Ã±" (it should read "ñ").', "If you see “√©” instead of “é”.", "It printed «â€™».", "Not “Ð¿Ð¾” but “по”.", "Une lettre : « à »."]
    texts = rows + cites + bad
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    operator = gt.GarbledText(frame)
    found = {r.doc_id: r.restored for r in operator.restored().collect()}
    assert [texts[i] for i in range(len(texts)) if (i in found) != (i >= len(rows + cites))] == []
    assert len(found) == len(bad) == 48
    right = [i for i in found if any(w in found[i] for w in ("поиск", "größere", "mañana"))]
    assert len(right) == 48, [found[i] for i in found if i not in right]


def test_nothing_is_found_in_clean_or_empty_tables(spark):
    frame = spark.createDataFrame(list(enumerate(CLEAN * 2)), "doc_id long, text string")
    assert gt.GarbledText(frame).found().collect() == []
    assert gt.GarbledText(frame.limit(0)).found().collect() == []
    assert gt.GarbledText(frame.limit(0)).restored().collect() == []


def test_undo_inverts_lossless_chains():
    for text in ("größer", "поиск", "日本"):
        for chain, form in gt.chains(text):
            if "�" not in form and not chain.startswith(("latin-1>", "mac")) and gt.undo(form, chain) is not None:
                assert gt.undo(form, chain) == text, chain


def test_one_garbled_word_in_a_long_run_without_spaces(spark):
    sentence = "{}昨日の{}は検索の設定が原因でした。新しい版では辞書と端末が同時に更新されます。"
    numbers = "一二三四五六七八九十百千"
    rows = [sentence.format(f"第{n}回、", word) for n in numbers for word in ("障害", "更新障害")]
    bad = {}
    for word in ("障害", "更新障害"):
        for chain, form in gt.chains(word):
            if form != word and not form.isascii():
                bad.setdefault(sentence.format("", form), (chain, sentence.format("", word)))
    texts = [*rows, *bad]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    operator = gt.GarbledText(frame)
    got = {r.doc_id: r.restored for r in operator.restored().collect()}
    assert [texts[i] for i in got if i < len(rows)] == []
    assert [(bad[t][0], t[:16]) for i, t in enumerate(texts) if t in bad and i not in got] == []
    for chain in ("utf-8>cp1252", "utf-8>gb18030", "euc-jp>latin-1"):
        for i, text in enumerate(texts):
            if text in bad and bad[text][0] == chain and "\ufffd" not in text:
                assert got[i] == bad[text][1], chain


def test_a_third_of_the_rows_garbled_into_letters_of_other_languages(spark):
    french = "Le {} système a été mis à jour très tôt, même la première tâche reçoit déjà un numéro {}."
    spanish = "El {} pequeño módulo cambió después de un año, según la última versión {}."
    portuguese = "Não apague a configuração {}: às vezes as informações já estão lá, à direita {}."
    russian = "После сбоя сервер {} хранит копию данных каждую ночь, если поиск работает {}."
    clean = [t.format(k, k) for k in range(6) for t in (french, spanish, portuguese, russian)]
    polish = ["Zespół znalazł błąd, a pamięć działa świetnie.", "Ďakujem, ešte ráno sme mali štyri vŕby pri ceste."]
    to_1250 = lambda t: t.encode("latin-1").decode("cp1250")
    copies = [to_1250(french.format("x", "x"))] * 10
    hot = [to_1250(t.format(f"y{k}", k)) for k in range(12) for t in (french, portuguese, spanish)]
    small = ["По словам " + russian.format(k, k)[6:].encode("koi8-r").decode("cp1251") for k in range(20)]
    for bad in (copies, hot, small):
        texts = clean + polish + bad
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        operator = gt.GarbledText(frame)
        first = len(clean + polish)
        assert sorted(r.doc_id for r in operator.found().collect()) == list(range(first, len(texts)))
        if bad is not small:
            got = {r.doc_id: r.restored for r in operator.restored().collect()}
            assert all(to_1250(got[i]) == texts[i] and got[i] != texts[i] for i in range(first, len(texts)))


def test_text_written_in_iso8859_15(spark):
    clean = ["Das kostet €35 im Jahr {}.", "Pan Škoda czeka {}.", "Sa sœur a bon cœur {}.", "It costs {} a month."]
    rows = [t.format(k) for k in range(8) for t in clean]
    bad = ["It still costs ¤35 a month.", "It was ¦koda who called.", "C’est un c½ur ouvert."]
    frame = spark.createDataFrame(list(enumerate(rows + bad)), "doc_id long, text string")
    got = {r.doc_id: r.restored for r in gt.GarbledText(frame).restored().collect()}
    assert sorted(got) == [len(rows), len(rows) + 1, len(rows) + 2]
    assert [got[i] for i in sorted(got)] == ["It still costs €35 a month.", "It was Škoda who called.", "C’est un cœur ouvert."]
