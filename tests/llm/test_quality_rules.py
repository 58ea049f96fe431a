import re

from listingspark.llm import quality_rules as Q


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    part = lambda x, y: x / y if y else 0.0
    kept = not failed and part(len(re.findall(r"[#*$%&|<>]", text)), n) <= 0.15 and part(dup, len(lines)) <= 0.4
    unlisted = sum(any(a <= ord(c) <= b for a, b in Q.UNLISTED_SCRIPTS) for c in text)
    if 2 * unlisted <= sum(map(len, words)):
        kept = kept and 2 <= part(sum(map(len, words)), n) <= 14 and part(sum(w in Q.STOP_WORDS for w in words), n) >= 0.03
    kept = kept and part(sum(a == b for a, b in zip(words, words[1:], strict=False)), n) <= 0.2
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed, kept


def test_equals_by_hand(spark, documents, odd, prose):
    plain = "the cat and the dog sat on a mat by the door of the house and then went to sleep for the night in peace"
    texts = [
        *odd, plain, plain, plain + "\n" + plain, plain + " " + plain[:60] + "\n\n" + prose(4, 40) + " the of and", prose(1, 300), prose(1, 30) + " the and of", "go " * 60,
        "\n".join([plain, "x", "x", "x ", "", "x", "y", "y"]), plain.replace(" ", "# "), plain.upper(), "the " * 8 + plain + " the" * 9, plain[:20], "%" * 100,
        " ".join(["one two three four five six seven eight nine"] * 3), "漢 " * 30, prose(7, 20_000) + " the and of",
    ]
    docs = documents(enumerate(texts))
    rows = {r.doc_id: r for r in Q.quality(docs).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == by_hand(text), text
    kept = Q.kept_rows(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {i: t for i, t in enumerate(texts) if rows[i].kept}
    assert any(r.kept for r in rows.values())


def test_repeated_and_missing_rows(spark, documents):
    assert Q.quality(documents([])).count() == 0
    assert [r.n_words for r in Q.quality(documents([(1, "a b"), (1, "a b"), (None, None)])).collect()] == [2, 2, 0]


def test_plan_is_native_and_moves_nothing(spark, documents):
    plan = Q.quality(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


CLEAN = {
    "ru": "Вчера мы долго гуляли по старому парку и говорили о том, что скоро наступит зима, а потом вернулись домой и пили горячий чай с вареньем.",
    "el": "Το πρωί πήγαμε στην αγορά για να αγοράσουμε φρούτα και λαχανικά, και μετά καθίσαμε σε ένα μικρό καφέ κοντά στη θάλασσα με τους φίλους μας.",
    "ar": "ذهبنا في الصباح إلى السوق القديم من أجل شراء الفواكه والخضروات ثم جلسنا في مقهى صغير على شاطئ البحر مع الأصدقاء حتى غروب الشمس في المساء",
    "hi": "हम सुबह पुराने बाजार में फल और सब्जी खरीदने गए और उसके बाद समुद्र के किनारे एक छोटे होटल में दोस्तों के साथ शाम तक बैठे रहे",
    "pl": "Rano poszliśmy na stary targ po owoce i warzywa, a potem siedzieliśmy z przyjaciółmi w małej kawiarni nad morzem, bo nie padało i było jeszcze ciepło.",
    "tr": "Sabah meyve ve sebze almak için eski pazara gittik, sonra deniz kenarında küçük bir kahvede arkadaşlarla akşama kadar oturduk ve çok güzel bir gün geçirdik.",
    "he": "בבוקר הלכנו אל השוק הישן כדי לקנות פירות וירקות ואחר כך ישבנו עם חברים בבית קפה קטן על שפת הים עד הערב כי היה יום יפה מאוד",
    "ko": "우리는 아침에 오래된 시장에 가서 과일과 채소를 샀다 그리고 바닷가에 있는 작은 찻집에서 친구들과 저녁까지 앉아 이야기를 나누며 이 아름다운 하루를 보냈다 정말 즐거운 날이었다",
    "capitals": "IN THE MORNING WE WENT TO THE OLD MARKET FOR FRUIT AND GREENS, AND THEN SAT WITH FRIENDS IN A SMALL HOUSE BY THE SEA.",
}


def test_clean_texts_of_other_languages_and_in_capitals_are_kept(spark, documents):
    texts = [*CLEAN.values(), *[CLEAN[x].upper() for x in ("ru", "el", "pl")], " ".join(f"zq{i * i:x}" for i in range(60)), " ".join(f"{i * 37}.{i}" for i in range(60))]
    rows = {r.doc_id: r for r in Q.quality(documents(enumerate(texts))).collect()}
    assert [rows[i].kept for i in range(len(texts))] == [True] * (len(texts) - 2) + [False] * 2
    assert [by_hand(t)[-1] for t in texts] == [rows[i].kept for i in range(len(texts))]


OTHER = {
    "th": "เมื่อเช้านี้ เราไปตลาดเก่า เพื่อซื้อผลไม้และผัก หลังจากนั้น เรานั่งดื่มกาแฟ กับเพื่อนๆ ในร้านเล็กๆ ริมทะเล จนถึงเย็น อากาศดีมาก ท้องฟ้าสดใส ลมพัดเบาๆ เราคุยกัน เรื่องงาน เรื่องครอบครัว แล้วก็ เดินกลับบ้าน อย่างช้าๆ ด้วยกัน ก่อนค่ำ ทุกคน มีความสุข",
    "zh": "今天早上， 我们 去了 老市场， 买了 水果 和 蔬菜， 然后 和 朋友们 坐在 海边的 一家 小咖啡馆里， 一直 聊到 傍晚。 天气 很好， 风 很轻， 大家 都 很高兴， 最后 一起 慢慢地 走回家， 路上 还 看了 日落。",
    "ja": "今朝、 私たちは 古い市場へ 行って、 果物と 野菜を 買いました。 それから 友達と 一緒に 海の そばの 小さな 喫茶店に 座って、 夕方まで 話しました。 天気が よくて、 風も 弱く、 みんな とても 楽しかったです。 最後は ゆっくり 歩いて 帰り、 夕日も 見ました。",
    "te": "ఈ రోజు ఉదయం మేము పాత మార్కెట్‌కు వెళ్లి పండ్లు, కూరగాయలు కొన్నాము. తరువాత స్నేహితులతో సముద్రం దగ్గర ఉన్న చిన్న హోటల్‌లో కూర్చుని సాయంత్రం వరకు మాట్లాడుకున్నాము. వాతావరణం చాలా బాగుంది, అందరూ సంతోషంగా ఇంటికి నడిచి వెళ్ళారు.",
}


def test_scripts_without_a_list_are_judged_by_the_other_rules(spark, documents):
    long = "。".join(f"{x}日の朝に市場へ行きました" for x in range(30)) + " " + OTHER["ja"]
    texts = [*OTHER.values(), long, OTHER["zh"] + " ## ** $$ %% && || << >>", OTHER["te"] + "\n" + "\n".join([OTHER["te"][:12]] * 30), "𠀀𠀁 " * 3 + OTHER["zh"]]
    rows = {r.doc_id: r for r in Q.quality(documents(enumerate(texts))).collect()}
    assert [rows[i].kept for i in range(5)] == [True] * 5 and not rows[5].kept and not rows[6].kept
    assert [by_hand(t)[-1] for t in texts] == [rows[i].kept for i in range(len(texts))]


def test_sql_agrees_on_other_scripts(spark, documents):
    import duckdb

    from listingspark.llm import queries

    texts = [*OTHER.values(), *CLEAN.values(), "𠀀𠀁 " * 30, "漢字かな " + "the cat and the dog " * 3, None, "", " " * 9]
    rows = {r.doc_id: (r.n_words, r.base_failed, r.kept) for r in Q.quality(documents(enumerate(texts))).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    found = con.sql(f"SELECT doc_id, n_words, base_failed, kept FROM ({queries.ORACLE['op3_quality_rules']})").fetchall()
    assert {i: rest for i, *rest in found} == {i: list(v) for i, v in rows.items()}
