import pytest
from pyspark.sql import functions as F

from netloom.functions import kana, text
from netloom.functions import phonetics as P
from netloom.operators import names as N


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.o for r in df.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()]


def test_text_keys(spark):
    assert apply(spark, text.normalize_for_search, ["とうきょう１２３ＡＢＣ", "東京TOKYO"]) == ["トウキョウ123ABC", "東京TOKYO"]
    assert apply(spark, text.hiragana_to_katakana, ["東京えき", "ゔゖ"]) == ["東京エキ", "ヴヶ"]
    assert apply(spark, text.katakana_to_hiragana, ["シブヤー"]) == ["しぶやー"]
    assert apply(spark, text.strip_macrons, ["Tōkyō Ā"]) == ["Tokyo A"]
    assert apply(spark, text.title_case, ["shin-ōsaka eki2go", "ŌSAKA"]) == ["Shin-Ōsaka Eki2Go", "ŌSAKA"]
    assert apply(spark, text.match_key, ["霞ヶ関駅", "空港（第2ビル）駅", " ＪＲ 難波・駅前", "木ノ本停留場", "ｼﾌﾞﾔ駅"]) == [
        "霞ケ関", "空港", "JR難波", "木の本", "シブヤ"]
    assert apply(spark, text.gtfs_minutes, ["25:30:30", "8:05", "x", None]) == [1530.5, 485.0, None, None]
    assert apply(spark, text.clock_time, ["08:30", "8:03", "25:30:00", "08:60", "invalid", ""]) == [
        "08:30:00", "08:03:00", "25:30:00", None, None, None]
    assert apply(spark, text.hash_prefixed_color, ["AA00BB", "#AA00BB", ""]) == ["#AA00BB", "#AA00BB", None]


def test_half_width_kana(spark):
    assert apply(spark, kana.to_fullwidth_katakana, ["ﾆｼﾊﾁｵｳｼﾞｴｷﾐﾅﾐｸﾞﾁ", "ﾊﾟｰｸ･ｳﾞｨﾗ", "ひらがな", "ｱﾞ"]) == [
        "ニシハチオウジエキミナミグチ", "パーク・ヴィラ", "ヒラガナ", "アﾞ"]


@pytest.mark.parametrize("reading,roman", [
    ("トウキョウ", "tōkyō"), ("オオサカ", "ōsaka"), ("キュウシュウ", "kyūshū"), ("イッチョウメ", "itchōme"), ("サッポロ", "sapporo"),
    ("シンジュク", "shinjuku"), ("クウコウ", "kuukō"), ("ニイガタ", "niigata"), ("ケイオー", "keiō"), ("ティールーム", "tīrūmu"),
    ("ミナミ・マチ", "minami machi"), ("ああ　いい", "aa ii"), ("東京", None), ("ンー", None), ("", None), ("・", None),
    ("トォウ", "toō"), ("コウウィ", "kōi"), ("カッ アッ", "ka a"), ("コオロギ", "kōrogi"), ("ヲウ", "ō"), ("ジュウオウ", "jūō"),
])
def test_romaji(spark, reading, roman):
    assert apply(spark, kana.kana_to_romaji, [reading]) == [roman]


@pytest.mark.parametrize("reading,ipa", [
    ("シブヤ", "ɕibɯja"), ("ロッポンギ", "ɾoppoŋgi"), ("シンジュク", "ɕiɲdʑɯkɯ"), ("ニッポリ", "ɲippoɾi"), ("イッチョウメ", "itt͡ɕo.ɯme"),
    ("シンバシ", "ɕimbaɕi"), ("ギンザ", "ginza"), ("ギャク", "gʲakɯ"), ("デンエン", "deɴeɴ"), ("コーエン", "ko" + "ːeɴ"),
    ("ミナミ・マチ", "minami matɕi".replace("tɕ", "t͡ɕ")), ("カイガン", "ka.igaɴ"), ("サンカク", "saŋkakɯ"), ("ABC", None), ("", ""), ("リンッキ", "ɾiɲkkʲi"),
])
def test_kana_ipa(spark, reading, ipa):
    assert apply(spark, P.kana_to_ipa, [reading]) == [ipa]


@pytest.mark.parametrize("word,reading", [
    ("shibuya", "シブヤ"), ("nippori", "ニッポリ"), ("shimbashi", "シンバシ"), ("shin'ei", "シンエイ"), ("konnyaku", "コンニャク"),
    ("gakkou", "ガッコウ"), ("kyoto", "キョト"), ("jyunko", "ジュンコ"), ("bitchu", None), ("si", None), ("k'a", None), ("san", "サン"), ("vaio", "ヴァイオ"),
])
def test_romaji_to_kana(spark, word, reading):
    assert apply(spark, P.romaji_to_katakana, [word]) == [reading]


def spoken(spark, *pairs):
    names = spark.createDataFrame(list(pairs), "name_k string, name_r string")
    out = {}
    for r in N.tts_segments(names, N.english_words(spark)).orderBy("token_no", "part").collect():
        out.setdefault((r.name_k, r.name_r), []).append((r.surface, r.pronunciation, r.lang, r.separator))
    return out


def test_segments(spark):
    got = spoken(spark, ("カサイリンカイコウエン", "Kasai-Rinkai Park"), ("イナゲカイガン", "Inagekaigan"), ("シブヤ", "???"),
                 ("シブヤ", None), ("ロク", "ShinRoku 12"), ("ナゾ", "Xqz Park"), ("漢字", "Xqz"))
    assert [s[1] for s in got[("カサイリンカイコウエン", "Kasai-Rinkai Park")]] == ["kasa.i", "liŋka.i", "pɑɹk"]
    assert got[("イナゲカイガン", "Inagekaigan")] == [("Inage", "inage", "ja-JP", " "), ("kaigan", "ka.igaɴ", "ja-JP", "")]
    assert got[("シブヤ", "???")] == got[("シブヤ", None)] == [("シブヤ", "ɕibɯja", "ja-JP", "")]
    assert got[("ロク", "ShinRoku 12")] == [("Shin", "ɕiɴ", "ja-JP", " "), ("Roku", "lokɯ", "ja-JP", " "), ("12", "wʌntuː", "en-US", "")]
    assert [s[0] for s in got[("ナゾ", "Xqz Park")]] == ["ナゾ"]
    assert ("漢字", "Xqz") not in got


def test_pronunciations(spark):
    names = spark.createDataFrame([("イナゲカイガン", "Inagekaigan"), ("シブヤ", None)], "name_k string, name_r string")
    got = {r.name_k: (r.name_ipa, r.name_roman_ipa) for r in N.pronounce_names(names, N.english_words(spark)).collect()}
    assert got == {"イナゲカイガン": ("inageka.igaɴ", "inage ka.igaɴ"), "シブヤ": ("ɕibɯja", "ɕibɯja")}
    lines = spark.createDataFrame([("トウカイドウホンセン", "Tokaido Line"), ("トウカイドウシンカンセン", None), ("セン", "")], "name_k string, name_r string")
    got = {r.name_k: (r.name_ipa, r.name_roman_ipa) for r in N.pronounce_lines(lines, N.english_words(spark)).collect()}
    assert got["トウカイドウホンセン"] == ("to.ɯka.ido.ɯ meɪn laɪn", "toka.ido laɪn")
    assert got["トウカイドウシンカンセン"][0].endswith("ɕiŋkaɴseɴ".replace("kaɴs", "kans")) and got["セン"][0] == "seɴ"


def test_audit(spark):
    names = spark.createDataFrame([(1, "Bqx Park"), (2, "Bqx"), (3, "Bqx Bqx"), (4, "Shibuya"), (5, "Zzq"), (6, "Bqx Shibuya"), (7, " ")], "ord int, name_r string")
    got = [tuple(r) for r in N.audit_pronunciation(names, N.english_words(spark)).orderBy("token").collect()]
    assert got == [("bqx", 5, ["Bqx", "Bqx Bqx", "Bqx Park"]), ("zzq", 1, ["Zzq"])]


def test_audit_of_names_without_or_with_repeated_ord(spark):
    names = spark.createDataFrame([(1, "Bqx Park. bqx."), (1, "Bqx Park. bqx."), (1, "Bqx"), (2, "Bqx"), (5, "Zbqx"), (3, "Bqx Bqx"), (4, "Bqx a"), (None, "Nqq bqx"),
                                   (None, "Nqq bqx"), (None, None)], "ord int, name_r string")
    got = sorted(tuple(r) for r in N.audit_pronunciation(names, N.english_words(spark)).collect())
    assert got == [("bqx", 11, ["Bqx", "Bqx Bqx", "Bqx Park. bqx."]), ("nqq", 2, ["Nqq bqx"]), ("zbqx", 1, ["Zbqx"])]


def test_the_whole_word_table_is_spoken(spark):
    assert len(N.ENGLISH) == 322 and N.ENGLISH["centre"] == N.ENGLISH["center"]
    names = spark.createDataFrame([(1, "Skyliner through Village"), (2, "Mt.Fuji qqz"), (3, "St. Mary's Police School")], "ord int, name_r string")
    assert [r.token for r in N.audit_pronunciation(names, N.english_words(spark)).collect()] == ["qqz"]
    said = N.pronounce_names(spark.createDataFrame([("スカイ", "Skyliner Plaza")], "name_k string, name_r string"), N.english_words(spark)).first()
    assert said.name_roman_ipa == f"{N.ENGLISH['skyliner']} {N.ENGLISH['plaza']}"


def test_audit_cuts_names_into_words_once(spark, monkeypatch):
    written = []
    real = N.C.materialize
    monkeypatch.setattr(N.C, "materialize", lambda df, name: (written.append((name, df)), real(df, name))[1])
    names = spark.createDataFrame([(1, "Qzx. Qzx Park"), (2, "Ōqzx")], "ord bigint, name_r string")
    got = sorted((r.token, r["count"]) for r in N.audit_pronunciation(names, N.english_words(spark)).collect())
    assert got == [("ouqzx", 1), ("qzx", 2)]
    (words,), (bad,) = [d for n, d in written if n == "words"], [d for n, d in written if n == "silent-words"]
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("md5(")  # the digest is below the words, once a name
    assert "Generate explode(regexp_extract_all" not in bad._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in bad._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_cut_into_words_once(spark, monkeypatch):
    public = spark.createDataFrame([(1, "カサイ", "Kasai Park"), (2, "カサイ", "Kasai Park"), (3, "シン", None)], "id int, name_katakana string, name_roman string")
    want = {r.id: r for r in N.speak(public, N.english_words(spark)).collect()}
    calls, real = [], N.tts_segments
    monkeypatch.setattr(N, "tts_segments", lambda *a: calls.append(a) or real(*a))
    got = {r.id: r for r in N.speak(public, N.english_words(spark)).collect()}
    assert len(calls) == 1 and got == want and got[1].name_segments == got[2].name_segments
