import numpy as np
import pandas as pd
import pytest

from loomtext.llm import codepoints as cp
from loomtext.llm import labels, langid, mojibake, sentences, textstats, truncation

SCHEMA = "doc_id bigint, text string, lang string, source string, metadata_json string, kind string"
EN = ["The gate was sealed at {n} a.m. by Ann Müntzig in spite of the rain.", "Dr. Pellicant checked the valve and read 3.{n} mm.", "Who left the crane open? Nobody knew.", "There were {n} crates in the yard, not 7 as the first count claimed."]
ES = ["La grúa quedó marcada como retrasada por Ann Müntzig.", "El Dr. Pellicant revisó la válvula a las {n} y leyó 3,{n} mm.", "¿Quién abrió la puerta? Nadie respondió.", "Durante la noche la temperatura bajó y nadie cerró el almacén."]


def prose(k, forms):
    rng = np.random.default_rng(k)
    return " ".join(forms[int(i)].format(n=k % 50 + 1) for i in rng.integers(len(forms), size=6))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, prose(k, EN), "en", "a", '{"title": "State of the gate – Ann Müntzig"}', "clash") for k in range(150)]
    rows += [(1000 + k, prose(k, ES), "es", "b", '{"title": "Nota de inspección"}', "clash") for k in range(150)]
    rows += [
        (2000, prose(1, EN).encode().decode("cp1252"), "en", "a", None, ""), (2001, prose(2, EN), "es", "a", '{"title": "State of the gate â€“ Ann MÃ¼ntzig"}', ""),
        (2002, prose(3, EN) + "\n\n" + prose(4, ES), "en", "a", None, ""), (2003, prose(5, ES), None, "b", None, ""), (2004, None, "en", "a", None, ""), (2005, "", "en", "a", "", ""), (2006, " \n ", "en", "a", "{}", ""),
        (2007, "\n".join(f"- the gate – sealed {k}" for k in range(20)), "en", "a", None, ""), (2008, "\n".join(f"item;state;n{k};x" for k in range(20)), "en", "a", None, ""), (2009, "0f 1e 2d " * 1, "und", "a", None, ""),
        (2010, prose(6, EN) + " The gate was sea", "en", "a", None, ""), (2011, prose(7, EN) + " Ann M�ntzig slept.", "en", "a", None, ""), (2012, prose(8, EN) * 60, "en", "a", None, "")]
    rows += [(3000 + k, "\n".join(f"- the gate – sealed {j}" for j in range(k + 4)), "en", "a", None, "") for k in range(15)]
    rows += [(4000 + k, "\n".join(f"item;state;n{j};x" for j in range(k + 4)), "en", "a", None, "") for k in range(15)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_labels():
    assert [labels.code_of(x) for x in ("EN", "en-US", "eng", "English", "zh-Hans", "und", "", None, "??", "mul")] == ["en", "en", "en", "en", "zh", None, None, None, None, None]


def test_hashes_agree_with_single_words():
    points, _ = cp.flatten(["ab cd", "ab"])
    s, e = cp.word_spans((cp.flags_of(points) & cp.LETTER) != 0)
    assert cp.span_hashes(points, s, e).tolist() == [cp.word_hash(w) for w in ("ab", "cd", "ab")]


def test_counts_by_brute_force():
    texts = ["Ab 12!\n\n- the x", "a", "漢字。 ok"]
    n = textstats.count_batch(texts)
    assert n["char_count"].tolist() == [len(t) for t in texts]
    assert n["letter_count"].tolist() == [sum(c.isalpha() for c in t) for t in texts]
    assert n["digit_count"].tolist() == [2, 0, 0]
    assert n["line_count"].tolist() == [2, 1, 1] and n["common_words"].tolist()[0] == 1


def test_rules_are_learned_and_exported():
    rng = np.random.default_rng(0)
    x = rng.random((400, len(textstats.FEATURES)))
    labels_ = np.where(x[:, 3] > 0.7, "table", np.where(x[:, 5] > 0.8, "hex", "prose")).astype(object)
    rules = textstats.induce(x, labels_)
    case = textstats.case_of(rules)
    assert "THEN 'table'" in case and "THEN 'junk'" in case and textstats.case_of([]) == "'prose'"


def test_kinds(corpus):
    got = {r.doc_id: r.kind for r in textstats.with_kind(corpus).select("doc_id", "kind").collect()}
    assert got[2007] == "list" and got[2008] == "table" and got[5] == "prose" and got[2012] == "prose"
    assert 2004 not in got and 2005 not in got and got[2006] == "prose"
    assert textstats.with_kind(corpus.limit(0)).count() == 0


def test_garbled(corpus):
    got = {(r.doc_id, r.field): r for r in mojibake.garbled_fields(corpus, restore=True).collect()}
    assert (2000, "text") in got and (2001, "metadata_json") in got and (2011, "text") in got
    assert "Müntzig" in got[2001, "metadata_json"].restored
    assert not [k for k in got if k[0] < 2000]
    assert mojibake.garbled_fields(corpus.limit(0)).count() == 0


@pytest.mark.parametrize("chain", mojibake.CHAINS[:3] + [("latin-1", "cp1251"), ("cp1251", "koi8-r")])
def test_undo_is_the_way_back(chain):
    text = "ночь" if chain[1] != "utf-8" else "Müntzig – é"
    raw = text.encode(chain[1])
    assert mojibake.undo("".join(bytes([b]).decode(chain[0], "ignore") or chr(b) for b in raw), chain) == text


def test_languages(corpus):
    got = {}
    for r in langid.with_segments(corpus, True).orderBy("char_start").collect():
        got.setdefault(r.doc_id, []).append((r.char_start, r.lang))
    assert got[2001] == [(0, "en")] and got[2003] == [(0, "es")]
    assert [lang for _, lang in got[2002]] == ["en", "es"] and got[2002][1][0] == len(prose(3, EN)) + 2
    assert not {2004, 2005, 2006} & set(got) and len([d for d in got if d < 2000]) <= 6
    assert langid.with_segments(corpus.limit(0), True).count() == 0


def test_units(corpus, spark):
    of = spark.createDataFrame([(0,), (0,), (2004,), (2006,), (9999,)], "doc_id bigint")
    rows = sentences.sentence_units(corpus, of).orderBy("char_start").collect()
    text = prose(0, EN)
    want = [p for k in np.random.default_rng(0).integers(len(EN), size=6) for p in ([EN[int(k)].format(n=1)] if int(k) != 2 else ["Who left the crane open?", "Nobody knew."])]
    assert [text[r.char_start:r.char_end] for r in rows] == want and {r.doc_id for r in rows} == {0}


def counts_of(texts, lang):
    rows = pd.concat(sentences._count([pd.DataFrame({"text": texts, "lang": lang})])).groupby(["grp", "key"], as_index=False)["n"].sum()
    return sentences.totals_and(rows.assign(total=rows.groupby("grp")["n"].transform("sum")))


def test_unit_rules():
    judge = sentences.Judge(counts_of([prose(k, EN) for k in range(200)], "en"))

    def cut(t):
        return [t[s:e] for s, e in sentences.split_text(t, judge)]

    assert cut("Title\n\nThe gate was sealed.Nobody knew.\n\n— Ann") == ["Title", "The gate was sealed.", "Nobody knew.", "— Ann"]
    assert cut('The slip reads "Gate 9 is sealed. Do not open." and is signed. (Nobody knew.) Who?') == ['The slip reads "Gate 9 is sealed. Do not open." and is signed.', "(Nobody knew.)", "Who?"]
    assert cut("“Leave it!” Ann shouted. Dr. Pellicant left.") == ["“Leave it!” Ann shouted.", "Dr. Pellicant left."]
    assert cut("[01:02] Ann: Who left?\n[01:03] Bo: The gate was open. Nobody knew.") == ["[01:02] Ann: Who left?", "[01:03] Bo: The gate was open.", "Nobody knew."]
    assert cut("门开了。“谁开的？”他问道。") == ["门开了。", "“谁开的？”他问道。"]
    assert cut("  \n\n ") == [] and cut("") == []


def test_cut_off(corpus):
    got = {r.doc_id for r in truncation.cut_off(corpus).collect()}
    assert 2010 in got and not {2004, 2005, 2006, 2012} & got and len([d for d in got if d < 2000]) == 0
    rates = {r.source: r for r in truncation.rates(corpus).collect()}
    assert rates["a"].cut >= 1 and rates["b"].rate == 0
    assert truncation.cut_off(corpus.limit(0)).count() == 0


def test_cut_off_where_hashes_share_a_slot(corpus, spark):
    """Words whose hashes agree in 19 bits with that of a fragment are other words all the same."""
    def slot(h):
        return (np.asarray(h, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)

    letters = np.random.default_rng(4).integers(97, 123, (4_000_000, 9)).astype(np.uint32)
    start = np.arange(0, letters.size, 9)
    same = np.flatnonzero(slot(cp.span_hashes(letters.ravel(), start, start + 9)) == slot(cp.word_hash("seal")))[:3]
    assert len(same) == 3
    other = " ".join("".join(map(chr, letters[k])) for k in same)
    more = spark.createDataFrame([(5000, prose(9, EN) + " The gate was seal", "en", "c", None, "")] + [(5001 + k, f"The {other} was seen. {prose(k, EN)}", "en", "a", None, "") for k in range(3)], SCHEMA)
    assert 5000 in {r.doc_id for r in truncation.cut_off(corpus.unionByName(more)).collect()}


def test_cut_off_inside_a_long_word(corpus, spark):
    more = spark.createDataFrame([(5000, "Ann Müntzig bleef bij de haven verantwoordel", "nl", "c", None, "")] + [(5001 + k, f"Zij is verantwoordelijk. {prose(k, EN)}", "nl", "a", None, "") for k in range(3)], SCHEMA)
    assert 5000 in {r.doc_id for r in truncation.cut_off(corpus.unionByName(more)).collect()}


def test_prefixes_are_whole_and_agree_with_words():
    points, _ = cp.flatten(["verantwoordelijk"])
    h, owner = truncation.prefixes(points, np.array([0]), np.array([16]))
    assert h.tolist() == [cp.word_hash("verantwoordelijk"[:k]) for k in range(1, 16)] and set(owner) == {0}


def test_network_has_twenty_filters_a_width_in_both_passes():
    net = langid.Net(["en", "es", "pt"])
    assert net.dense.shape[0] == 20 * len(langid.WIDTHS)
    x = np.random.default_rng(0).integers(0, 256, (70, langid.WINDOW)).astype(np.uint8)
    z = net.pooled(x)[0] @ net.dense + net.shift
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(net.log_probabilities(x), want, atol=1e-4)


def test_units_follow_a_change_of_language():
    """Gal. ends English sentences and is a Spanish title; the language is that of the place, not of the text's start."""
    en = [prose(k, EN) + " We filled one gal." for k in range(200)]
    es = [f"El Gal. Pellicant durmió. {prose(k, ES)}" for k in range(200)]
    judge = sentences.Judge(counts_of(en + es, ["en"] * 200 + ["es"] * 200))
    english, spanish = " ".join(en[:30]), "El Gal. Pellicant revisó la válvula durante la noche. Nadie cerró el almacén. " + prose(3, ES)

    def ends(t):
        return {t[s:e].split()[-1] for s, e in sentences.split_text(t, judge)}

    assert len(english) > 5_000
    assert "Gal." not in ends(english + " " + spanish) and "gal." in ends(english + " " + spanish)  # in one block
    short = "El Gal. Pellicant durmió."
    assert "Gal." not in ends("\n\n".join([english] * 4 + [" ".join(es)] * 3 + [short]))  # of fewer than 8 tokens, judged by the whole text


def test_a_wide_run_is_restored_beside_a_short_one():
    clean = ["Ann Müntzig slept.", "鍵は霧谷倉庫へ運ばれました。江里須港の引き継ぎは誰も答えなかった。"] * 40
    b = pd.concat(mojibake._train([pd.DataFrame({"text": clean, "metadata_json": None})]))
    r = mojibake.Restorer(mojibake.Model(b["trigram"].to_numpy(), b["n"].to_numpy()), 1.8)
    wide = "江里須港の引き継ぎは誰も答えなかった。"
    text = "Ann MÃ¼ntzig slept.\n" + "".join(bytes([x]).decode("cp1252", "ignore") or chr(x) for x in wide.encode("shift_jis"))
    assert r.restored(text, r.suspicious([text])[0])[0] == "Ann Müntzig slept.\n" + wide


def test_trigrams_that_share_a_slot_keep_their_own_counts():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1 << 40, 1 << 62, 5_000))
    n = rng.integers(1, 1000, len(keys))
    m = mojibake.Model(keys, n)
    assert len(m.more) > 0  # some slots are taken twice
    assert np.allclose(m(keys), np.log((n + mojibake.EACH) / (n.sum() + mojibake.UNSEEN)), atol=1e-4)
    assert (m(keys + 1)[~np.isin(keys + 1, keys)] == np.float32(m.unseen)).all()


def test_metadata_is_restored_as_json(corpus):
    import json

    got = {(r.doc_id, r.field): r for r in mojibake.garbled_fields(corpus, restore=True).collect()}
    assert json.loads(got[2001, "metadata_json"].restored) == {"title": "State of the gate – Ann Müntzig"}


def test_easily_undone():
    for text in ("Müntzig – é", "Найдено", "検査", "“Leave it!” – no", "plain"):
        for read in ("cp1252", "latin-1", "mac_roman"):
            bad = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in text.encode())
            assert mojibake.easily_undone(bad) == text
        assert mojibake.easily_undone(text) == text
    assert mojibake.easily_undone("scell+AOk. 1+1-2") == "scell+AOk. 1+1-2" and mojibake.easily_undone("AOk +AOk-crit") == "AOk écrit"


def test_a_key_seen_once_in_a_million_counts(spark):
    """'Zq.' stands once among more than a million periods that end paragraphs, and inside its sentence."""
    docs = spark.createDataFrame([(1, "We met Zq. Ann today.", "en"), (2, "He left.\n\n" * 1_100_000, "en")], "doc_id bigint, text string, lang string")
    rows = sentences.sentence_units(docs, docs.where("doc_id = 1").select("doc_id")).collect()
    assert [(r.char_start, r.char_end) for r in rows] == [(0, 21)]


def test_counts_written_by_slices_are_those_of_one_table(spark, corpus, monkeypatch):
    want = sentences.learn(corpus).value
    monkeypatch.setattr(sentences, "SLICE", 100)
    keys, n = sentences.learn(corpus).value
    assert len(keys) > 300 and (np.diff(keys) > 0).all()
    assert (keys == want[0]).all() and (n == want[1]).all()


def test_the_margin_is_validated_on_the_runs_of_all_clean_records(spark):
    """3,000 records, each of up to 1,000 words: none is passed over, and each run counts as often as it occurs."""
    letters = "опрстуфхцч"
    texts = [f"Ann {letters[k % 10]}{letters[k // 10 % 10]}{letters[k // 100 % 10]} – {letters[k % 7]}." for k in range(3_000)]
    assert not any(map(mojibake.doubtful, texts))
    docs = spark.createDataFrame([(k, t, '{"title": "São"}' if k % 2 else None) for k, t in enumerate(texts)] + [(9000, "Ann MÃ¼ntzig", None), (9001, None, None)], "doc_id bigint, text string, metadata_json string")
    model, runs = mojibake.learn(docs)
    every = [(s[max(0, m.start() - 2):m.start()], m.group(), s[m.end():m.end() + 2]) for k, t in enumerate(texts) for s in [t] + ["São"] * (k % 2) for m in mojibake.SHORT_RUN.finditer(s)]
    assert runs.agg({"n": "sum"}).first()[0] == len(every) and runs.count() == len(set(every))
    shared = spark.sparkContext.broadcast(model)
    rows = runs.mapInPandas(mojibake._gains(shared), "garbled boolean, gain bigint, n bigint").toPandas()
    r = mojibake.Restorer(model)
    r.common = np.inf
    chance, rights = [r.best(*x)[0] for x in every], [r.best(*x)[0] for x in map(mojibake.garble, every) if x]
    want = []
    for got, gains, q in ((rows[~rows.garbled], chance, 0.9995), (rows[rows.garbled], rights, 0.03)):
        got = got.sort_values("gain")
        assert got.n.sum() == len(gains)
        want.append(np.quantile(gains, q))
        assert abs(mojibake.quantile(got.gain.to_numpy() / mojibake.STEPS, got.n.to_numpy(), q) - want[-1]) < 2 / mojibake.STEPS
    assert abs(mojibake.validate(shared, runs) - np.clip(want[0] + 0.25 * max(want[1] - want[0], 0), 1.5, 4)) < 2 / mojibake.STEPS


def test_runs_judged_together_are_judged_as_alone():
    clean = ["Ann Müntzig slept – é.", "Ночь была тихой.", "鍵は霧谷倉庫へ運ばれました。"] * 40
    b = pd.concat(mojibake._train([pd.DataFrame({"text": clean, "metadata_json": None})]))
    b = b[b.run.isna()]
    r = mojibake.Restorer(mojibake.Model(b["trigram"].to_numpy(), b["n"].to_numpy()), 1.5)
    runs = [(" M", "Ã¼", "nt"), (" M", "ü", "nt"), ("", "é", ""), ("p ", "â€“", " Ã"), ("", "Íî÷ü", " á"), ("", "�", ""), ("a", "œ", "b")]
    for run, got in zip(runs, r.best_of(runs)):
        stands, want = r.mean("".join(run)), (-99.0, "", run[1])
        for chain in mojibake.CHAINS if stands <= r.common else ():
            text = run[1]
            for depth in range(3 if chain[1] == "utf-8" else 1):
                if (out := mojibake.undo(text, chain)) is None:
                    break
                gain = r.mean(run[0] + out + run[2]) - stands - 0.3 * depth - 2.0 * (len(run[1]) < 3 and chain[1] != "utf-8")
                if gain > want[0] + 1e-9:
                    want = (gain, " ".join([f"{chain[1]}>{chain[0]}"] * (depth + 1)), out)
                text = out
        assert got[1:] == want[1:] and abs(got[0] - want[0]) < 1e-6
    assert r.best_of(runs)[0][2] == "ü" and r.best_of(runs)[4][2] == "Ночь"


def test_equal_pieces_are_judged_once_and_as_alone(monkeypatch):
    net = langid.Net(["en", "es", "pt"])
    said = ["the gate was sealed by ann", "12 3", "", "la grúa quedó", "the gate was sealed by ann", "鍵は霧谷倉庫へ" * 60, "la grúa quedó"]
    windows = []
    whole = langid.Net.log_probabilities
    monkeypatch.setattr(langid.Net, "log_probabilities", lambda self, x: windows.append(len(x)) or whole(self, x))
    logs, weight = langid.score_pieces(net, said)
    assert sum(windows) == len(langid.windows_of(list({p for p in said if langid._letters(p) >= 4}))[0])
    again, _ = langid.score_pieces(net, said[::-1])
    for p, row, other, w in zip(said, logs, again[::-1], weight):
        n = langid._letters(p)
        x, _ = langid.windows_of([p if n >= 4 else ""])
        assert np.allclose(row, whole(net, x).mean(0) if len(x) else 0, atol=1e-5) and np.allclose(row, other, atol=1e-6)
        assert w == (min(n / 20, 3.0) if n >= 4 else 0)
    assert langid.letters_of(said).tolist() == [langid._letters(p) for p in said]
    assert langid.score_pieces(net, [])[0].shape == (0, 3)


def test_rough_pieces_keep_their_marks():
    assert langid.rough('One. Two!) Three?\n\nFour。」五！\n 3.5 "six." ') == ["One.", "Two!", "Three?", "Four。", "五！", " 3.5 \"six."]
    assert langid.rough("\n\n \n") == [] and langid.rough("") == [] and langid.rough("plain") == ["plain"]
