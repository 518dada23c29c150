import random

import numpy as np
import pytest

from relweave.llm import mojibake

FR = "le été où à même être dès forêt garçon très âge père mère célèbre hôtel naïve reçu façade élève théâtre".split()
RU = "что было очень дом хорошо человек время работа жизнь день рука глаз слово место вопрос город земля вечер".split()
EN = "the of water and house time people year way day thing man world life hand part child eye place work week".split()


def corpus(n=1500):
    rng = np.random.default_rng(9)
    out = []
    for k in range(n):
        lang = (FR, RU, EN)[k % 3]
        text = " ".join(rng.choice(lang, 25)).capitalize() + (" — “so” 25 °C…" if k % 5 == 0 else ".")
        out.append((k, text))
    return out


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(1)
    clean = corpus()
    rows, bad = [], {}
    for k, t in clean:
        if k % 20 == 0 and not t.isascii():
            words = t.split(" ")
            at = [i for i, w in enumerate(words) if not w.isascii()]
            chosen = at if k % 40 == 0 else [rng.choice(at)]
            e = rng.choice(["cp1252", "latin-1", "cp1251", "cp437", "mac_roman"])
            for i in chosen:
                words[i] = "".join(mojibake.CHARACTERS[e][b] for b in words[i].encode("utf-8"))
            bad[k] = t
            t = " ".join(words)
        rows.append((k, t))
    rows += [(9001, "Text with a lost ch�racter"), (9002, None), (9003, ""), (None, "x"), (9004, "plain ascii " * 100_000), (9005, "été " * 30_000)]
    bad[9001] = None
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, restored string")
    return df, bad


def test_found_and_restored(spark, case):
    df, bad = case
    got = {r.doc_id: r for r in mojibake.garbled_documents(df).collect()}
    assert len(set(got) & set(bad)) / len(bad) >= 0.97
    assert len(set(got) - set(bad)) <= 2
    exact = [k for k in bad if bad[k] and k in got and got[k].restored == bad[k]]
    assert len(exact) / sum(1 for k in bad if bad[k]) >= 0.9
    assert got[9001].restored is None


def test_round_trip_of_every_chain():
    for e in mojibake.SINGLE:
        garbled = "".join(mojibake.CHARACTERS[e][b] for b in "naïve — дом".encode("utf-8"))
        assert mojibake.decode_utf8(garbled, e) == "naïve — дом", e
    assert "очень" in mojibake.Chains()("очень".encode("cp1251").decode("latin-1"))
    twice = "é".encode().decode("latin-1").encode().decode("latin-1")
    assert mojibake.Chains()(twice)["é"].count("utf-8") == 2


def test_held_out_margin(case):
    _, _ = case
    # a token that is its own likeliest reading is left alone
    model = mojibake.Model(np.zeros(mojibake.TRI, "f4"), np.zeros(mojibake.BI, "f4"), np.zeros(mojibake.UNI, "f4"))
    assert mojibake.validate(model, []).gain == 8.0
    assert mojibake.Restorer(model, mojibake.Margin(5.0, 0.5, 0, 0))("plain") == (False, None, None)


def _as_read(text, e):
    return "".join(mojibake.CHARACTERS[e][b] for b in text.encode("utf-8"))


@pytest.fixture(scope="module")
def fitted(case):
    return mojibake.fit(case[0])


@pytest.mark.parametrize("joint", ["…", "_"])
def test_end_of_a_long_token(fitted, joint):
    rng = np.random.default_rng(5)
    for lang in (FR, RU):
        head, tail = (joint.join(rng.choice(lang, n)) + joint for n in (900, 4))
        tail += " ".join(w for w in lang if not w.isascii()).replace(" ", joint)
        for e in ("cp1252", "cp1251", "latin-1"):
            restorer = mojibake.Restorer(*fitted)
            text = head + _as_read(tail, e)
            restorer.learn([head + tail, text])
            assert restorer(head + tail) == (False, None, None)
            assert restorer(text)[:2] == (True, head + tail), e
            restorer.learn([whole := _as_read(head, e)])
            assert restorer(whole)[:2] == (True, head), e


def test_pieces_split_no_sequence():
    rng = random.Random(6)
    for length in (150, 201, 1500):
        plain = "".join(rng.choice("中文字符日本語ไทยдомéè’—") for _ in range(length))
        for e in ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251"):
            for token in (plain, _as_read(plain, e), _as_read(_as_read(plain, e), e)):
                parts = mojibake.pieces(token)
                assert "".join(p for p, _ in parts) == token and all(p in w for p, w in parts)
                assert max(len(w) for _, w in parts) <= 10 * mojibake.LONGEST
                for chain in (f"{e}>utf-8", f"{e}>utf-8 {e}>utf-8"):
                    assert "".join(mojibake.applied(chain, p) for p, _ in parts) == mojibake.applied(chain, token)


def test_every_clean_record_counts(spark):
    n = 60_000
    model, _ = mojibake.fit(spark.range(n).selectExpr("id AS doc_id", "if(id % 1000 = 7, 'le été ไทย', 'le été') AS text"))
    count = lambda c: model.uni[mojibake._hashed(mojibake._codes(c), mojibake.UNI)[0]]
    assert count("ไ") == n // 1000 and count("l") == n and count("é") == 2 * n


def test_every_held_out_token_validates(spark, monkeypatch):
    seen = []
    validate = mojibake.validate
    monkeypatch.setattr(mojibake, "validate", lambda model, tokens, *a, **k: seen.append((model, tokens)) or validate(model, tokens, *a, **k))
    rows = spark.range(2000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 49), k -> concat('é', translate(hex(xxhash64(id, k)), '0123456789ABCDEF', 'abcdefghijklmnop')))) AS text")
    _, margin = mojibake.fit(rows)
    held = {t for r in rows.filter(f"pmod(xxhash64(doc_id, 3), {mojibake.HELD_ONE_IN}) = 0").collect() for t in r.text.split(" ") if not t.isascii()}
    model, tokens = seen[-1]
    tokens = {r.token for r in tokens.collect()} if hasattr(tokens, "collect") else set(tokens)
    assert len(held) > 3000 and tokens == held
    gains = sorted((g for _, _, g in mojibake.best_candidates(model, sorted(held))), reverse=True)
    assert margin.gain == max(4.0, gains[len(held) // 1000]) and 0 < margin.recall <= 1


def test_empty(spark, case):
    df, _ = case
    assert mojibake.garbled_documents(df.limit(0)).count() == 0
    assert mojibake.garbled_documents(df.filter("text = ''")).count() == 0


def test_lost_characters_are_judged_by_the_model(fitted):
    model, margin = fitted
    assert model.lost_gain("t�te") > margin.gain and model.lost_gain("�") > margin.gain
    restorer = mojibake.Restorer(model, margin)
    restorer.learn(["tout � fait", "été"])
    assert restorer("tout � fait") == (True, None, None) and restorer("été") == (False, None, None)


def test_one_garbled_word_is_enough(spark, case):
    """Of clean records with a single short word garbled nearly all are found, and hardly any clean one is."""
    df, bad = case
    rng = random.Random(2)
    rows, n = [], 0
    for k, t in corpus(900):
        words = t.split(" ")
        at = [i for i, w in enumerate(words) if not w.isascii() and 2 <= len(w) <= 5]
        if at and k % 3 < 2:
            i = rng.choice(at)
            words[i] = _as_read(words[i], rng.choice(["cp1252", "latin-1", "cp1251"]))
            rows.append((k, " ".join(words)))
            n += 1
        else:
            rows.append((10_000 + k, t))
    fitted = mojibake.fit(df)
    got = {r.doc_id for r in mojibake.found_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), fitted=fitted).collect()}
    assert n > 100 and sum(k < 10_000 for k in got) >= 0.98 * n and sum(k >= 10_000 for k in got) <= 2


def test_long_ascii_token_is_linear(spark, fitted):
    df = spark.createDataFrame([(1, "a" * 3_000_000 + " été"), (2, "b" * 3_000_000)], "doc_id bigint, text string")
    assert mojibake.found_documents(df, fitted=fitted).count() == 0
