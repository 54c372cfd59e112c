import pytest

from trajspark.llm.sentences import Model, lowered, sentences, split, train


@pytest.fixture(scope="module")
def model(spark):
    return train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


CASES = [
    ["Dr. Astvel moved the cup at approx. 7 Hz.", "The arm put the lid into the bin."],
    ["On 3 Mar. 2025 the sink moved 9.2 cm, see App. B.", "The test ran until 5 p.m.", "Bring tape, cup holders, etc.", "The arm put the lid into the bin."],
    ['The operator asked "Where is the towel?" and pointed at the tray.', 'He said, "The coin slipped."', "The gripper opened... and the lid fell behind the shelf."],
    ['The label reads "navy lid. Do not lift." in small print.', "(The red marker was later found under the mat.)", "What a mess...", "The night shift logged 9 warnings."],
    ["Am 9. Mai wurde die Kiste neu vermessen.", "Die Episode Nr. 3 wurde z. B. ohne Becher beendet.", "Der Datenlader verlor 3 Bilder in Lauf 1636.", "Das Wiedergabeskript lief langsamer nach der Pause."],
    ["Il a noté : « Le cube glisse. »", "La caméra du coude a lâché le cube après la pause.", "« Lâchez le cube ! » a crié l’opératrice.", "Attention au bac !"],
    ["Съёмка велась с 2025 г. на стенде 3.", "«Отпусти кубик!» — крикнул оператор.", "См. рис. 20 и табл. 3."],
    ["รอบนี้อย่าแตะถาด", "ไฟล์ episode_002476.parquet มี 2 แถว", "อย่าแตะลิ้นชัก"],
    ["डॉ. वेलनकर ने 8 एपिसोड जाँचे।", '"कप छोड़ो!" संचालक ने कहा।', "कलाई चरण 2 पर क्यों रुका?"],
    ["قال المشغل: «اترك الكوب الآن.»", "لا تلمس الصندوق!", "لماذا توقف المعصم عند الخطوة 6؟"],
]
JOINED = [
    ["操作员说：“先放下方块。再后退。”", "（方块已经更换。）", "“停下！”操作员喊道。", "毛巾掉了……后来在碗下面找到。"],
    ["彼女は「もう一度。」と言って肩を戻した。", "（ボルトは交換済み。）", "「止まって。」と操作員が言った。", "棚に触らないで！"],
]


@pytest.mark.parametrize("want", CASES)
def test_sentences_of_many_languages(model, want):
    text = "  " + " ".join(want)
    assert [text[a:b] for a, b in split(text, model)] == want


@pytest.mark.parametrize("want", JOINED)
def test_scripts_without_spaces(model, want):
    text = "".join(want)
    assert [text[a:b] for a, b in split(text, model)] == want


def test_lines_and_list_marks(model):
    text = "1. Setup\r\n\n* The arm put the lid into the bin.\n2) What a mess...\n  \n- Why did the base stop at step 4?  "
    assert [text[a:b] for a, b in split(text, model)] == ["1. Setup", "* The arm put the lid into the bin.", "2) What a mess...", "- Why did the base stop at step 4?"]


def test_lower_case_documents(model):
    text = "nobody touched the box between run 489 and run 3. the data loader never released the peg at approx. 6 Hz. the arm put the lid into the bin."
    assert lowered(text)
    assert len(split(text, model)) == 3


def test_null_empty_blank_and_long(model, spark):
    assert split(None, model) == split("", model) == split(" \n\t ", model) == []
    long = "The arm put the lid into the bin. " * 20_000
    assert len(split(long, model)) == 20_000
    assert split("x" * 100_000, model) == [(0, 100_000)]
    rows = [(1, None, "en"), (2, "One. Two.", None), (3, "", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in sentences(df).collect()} == {2}
    assert sentences(spark.createDataFrame([], df.schema)).count() == 0


def test_without_statistics_a_period_ends_a_sentence():
    assert len(split("One two. Three four.", Model())) == 2


def test_every_visible_character_is_in_a_sentence(model, spark, data):
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        text = r["text"] or ""
        inside = set()
        last = 0
        for a, b in split(text, model):
            assert last <= a < b and not text[a].isspace() and not text[b - 1].isspace()
            inside.update(range(a, b))
            last = b
        assert all(c.isspace() or i in inside for i, c in enumerate(text))


def test_script_is_that_of_the_whole_text():
    assert Model().language("xабвг" * 200) == "ru"
    assert Model().language("xабвг" * 20) == "ru"


def test_collocated_abbreviations(model):
    for text in ("Mr. T. R. Fratarfra-Silrin filed 3 tickets.", "Prof. Dr. Silhem prüfte 1070 Aufnahmen."):
        assert len(split(text, model)) == 1


def test_hashed_types_are_the_engines(spark):
    from pyspark.sql import functions as F

    from trajspark.llm.sentences import Types, type_key

    words = ["", "a.", "größe", "ไทย", "##.|mai"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64(F.lit("period"), F.lit("de"), F.col("w")).alias("h"))
    assert {r["w"]: r["h"] for r in df.collect()} == {w: type_key("period", "de", w) for w in words}
    import numpy as np

    t = Types(np.array([type_key("period", "de", w) for w in words]), np.arange(5, dtype=np.float32))
    assert [t.get("period", "de", w) for w in words] == [0, 1, 2, 3, 4] and t.get("period", "en", "a.") is None


def test_language_and_case_given_or_told_alike(model, spark, data):
    from trajspark.llm.sentences import CASELESS

    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        if r["text"]:
            lang = model.language(r["text"])
            assert split(r["text"], model) == split(r["text"], model, lang, lang not in CASELESS and lowered(r["text"]))
