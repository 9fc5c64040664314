import random

import collections

from psephos.llm import quality

from . import helpers


def base(text):
    w = helpers.words(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {i + o for p in at.values() if len(p) > 1 for i in p for o in range(8)}
    lines = [x for x in (text or "").split("\n") if helpers.words(x)]
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n


TEXTS = [
    *helpers.EDGE_TEXTS,
    "a b c d e f g h i j k l m n o p q r s t a b c d e f g h",
    "a b c d e f g h a b c d e f g h a b c d e f g h",
    "x " * 30 + "the end is near & so <on> #1 *",
    "The council said on Monday that it would open the new road to the north of the town, and that the work would be done by the end of the year. " * 1,
]
CLEAN = (
    "The council said on Monday that it would open the road to the north of the town. A report on the cost of the work is to be given to the members in the spring, "
    "and those who live near the river have asked for a wall that is high enough for the floods of the last few years. It is not clear who will pay for it. "
    "The mayor told a meeting in the hall that the plan had support from most of the people in the area, but a group of farmers said that the land is needed "
    "for the cattle and that the new road would cut the farm in two. A vote is expected in June, after the election of the new members, and the work could start in the autumn."
)
JUNK = " ".join(f"{w.upper()}!!" for w in CLEAN.split()), " | ".join(f"item{i}" for i in range(150)), " ".join(f"{w}###" for w in CLEAN.split())


#: Clean texts in languages without a reference.
OTHER = {
    "ru": "Принимая во внимание, что признание достоинства, присущего всем членам человеческой семьи, и равных и неотъемлемых прав их является основой свободы, справедливости и всеобщего мира; "
    "и принимая во внимание, что пренебрежение и презрение к правам человека привели к варварским актам, которые возмущают совесть человечества, и что создание такого мира, в котором люди будут "
    "иметь свободу слова и убеждений и будут свободны от страха и нужды, провозглашено как высокое стремление людей; необходимо, чтобы права человека охранялись властью закона в целях обеспечения "
    "того, чтобы человек не был вынужден прибегать, в качестве последнего средства, к восстанию против тирании и угнетения. Все люди рождаются свободными и равными в своем достоинстве и правах. "
    "Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "pl": "Rada miasta ogłosiła w poniedziałek, że nowa droga na północ od rynku zostanie otwarta w maju, a prace mają się skończyć przed końcem roku. Mieszkańcy, którzy żyją nad rzeką, poprosili o mur, "
    "bo w ostatnich latach woda nie raz zalała ich domy. Nie jest jasne, kto za to zapłaci i czy pieniądze z budżetu na to wystarczą. Burmistrz powiedział na spotkaniu w ratuszu, że plan ma poparcie "
    "większości ludzi w okolicy, ale grupa rolników uważa, że ziemia jest potrzebna dla bydła i że droga przetnie ich pola na dwie części. Głosowanie odbędzie się w czerwcu, a po nim okaże się, "
    "czy prace mogą się zacząć jesienią. Do tego czasu nie wolno na tym terenie niczego budować i nie wolno sadzić drzew, a na drodze do lasu będzie stał znak.",
    "fi": "Kaupunginvaltuusto kertoi maanantaina, että uusi tie avataan keväällä ja että työt ovat valmiit ennen vuoden loppua. Joen lähellä asuvat ihmiset ovat pyytäneet muuria, koska vesi on viime vuosina "
    "noussut monta kertaa pihoille ja koteihin. Ei ole selvää, kuka sen maksaa ja riittävätkö rahat. Kaupunginjohtaja sanoi, että suunnitelma on saanut tukea ja että se on alueelle hyvä, mutta osa "
    "viljelijöistä sanoi, että maa on tarpeen karjalle ja että tie jakaa pellot. Äänestys on kesäkuussa, ja sen jälkeen on selvää, voivatko työt alkaa syksyllä. Sitä ennen alueelle ei saa rakentaa "
    "mitään, ei taloa eikä aitaa, ja metsään ei saa ajaa autolla. Tie on kapea ja se on talvella liukas, mutta se on ainoa, joka vie kylään ja sen kouluun.",
    "hi": "चूंकि मानव परिवार के सभी सदस्यों के जन्मजात गौरव और समान तथा अविच्छिन्न अधिकार की स्वीकृति ही विश्व शान्ति, न्याय और स्वतन्त्रता की बुनियाद है, चूंकि मानव अधिकारों के प्रति उपेक्षा और घृणा के फलस्वरूप ही ऐसे "
    "बर्बर कार्य हुए जिनसे मनुष्य की आत्मा पर अत्याचार किया गया, चूंकि एक ऐसी विश्व व्यवस्था की उस स्थापना को, जिसमें लोगों को भाषण और धर्म की आज़ादी तथा भय और अभाव से मुक्ति मिलेगी, सर्वसाधारण के लिए सर्वोच्च आकांक्षा "
    "घोषित किया गया है, चूंकि अगर अन्याययुक्त शासन और जुल्म के विरुद्ध लोगों को विद्रोह करने के लिए मजबूर नहीं होना है, तो कानून द्वारा नियम बनाकर मानव अधिकारों की रक्षा करना अनिवार्य है।",
    "zh": "鉴于对人类家庭所有成员的固有尊严及其平等的和不移的权利的承认，乃是世界自由、正义与和平的基础，鉴于对人权的无视和侮蔑已发展为野蛮暴行，这些暴行玷污了人类的良心。",
}
OTHER["zh"] = (
    OTHER["zh"] + "而一个人人享有言论和信仰自由并免予恐惧和匮乏的世界的来临，已被宣布为普通人民的最高愿望。鉴于为使人类不致迫不得已铤而走险对暴政和压迫进行反叛，有必要使人权受法治的保护。"
    "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。市议会星期一宣布，通往城北的新路将在春天开放，工程会在年底以前完成。住在河边的居民要求修一道墙，"
    "因为最近几年洪水多次淹没了他们的房子。目前还不清楚谁来付这笔钱。市长在会上说，这个计划得到了当地大多数人的支持，但是一些农民认为牛群需要这块土地，新路会把农场分成两半。"
)


def test_base_counts_and_rows(spark):
    df, rows = helpers.docs(spark, TEXTS)
    out = quality.judge(df)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(map(tuple, out.select(names).collect()), key=repr) == sorted(((i, *base(t)) for i, t in rows), key=repr)
    assert set(df.columns) <= set(out.columns)
    assert all(not (r.kept and r.base_failed) for r in out.collect())


def test_clean_stays_and_junk_goes(spark):
    df = spark.createDataFrame([(0, CLEAN), *enumerate(JUNK, 1)], "doc_id bigint, text string")
    assert {r.doc_id: r.kept for r in quality.judge(df).collect()} == {0: True, 1: False, 2: False, 3: False}


def test_clean_texts_of_languages_without_a_reference_stay(spark):
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(list(OTHER.items()), "doc_id string, text string")).collect()}
    # a script without spaces has few words as the base rule counts them
    assert {k: r.kept for k, r in got.items()} == dict.fromkeys(OTHER, True) | {"zh": False}
    assert got["zh"].base_failed and got["zh"].char_distance is None
    assert all(len(OTHER[k]) >= quality.MIN_CHARS_JUDGED for k in OTHER) and all(got[k].n_words >= quality.MIN_WORDS_JUDGED for k in OTHER if k != "zh")
    # junk of the same letters still goes
    junk = [(0, " ".join(f"{w.upper()}!!" for w in OTHER["ru"].split())), (1, " ".join(f"{w}###" for w in OTHER["pl"].split())), (2, "中文 " * 8)]
    assert not any(r.kept for r in quality.judge(spark.createDataFrame(junk, "doc_id bigint, text string")).collect())


def test_keyword_spam_goes(spark):
    """Text that only repeats its own words is of no other language."""
    rng = random.Random(1)
    lists = ["casino bonus poker slots jackpot win free spins deposit online betting roulette blackjack vip cash".split(), [f"kaufen{i}" for i in range(15)], "acheter pilule moins cher viagra cialis ordonnance".split()]
    df = spark.createDataFrame([(k, " ".join(rng.choices(words, k=200))) for k, words in enumerate(lists)], "doc_id bigint, text string")
    rows = quality.judge(df).collect()
    assert not any(r.kept for r in rows) and not any(r.base_failed for r in rows)


def test_short_texts_are_not_judged_by_distance(spark):
    df = spark.createDataFrame([(0, " ".join(f"{w.upper()}!!" for w in CLEAN.split()[:22]))], "doc_id bigint, text string")
    r = quality.judge(df).first()
    assert r.char_distance is None and r.word_distance is None and r.kept


def test_labels(spark):
    """Held against the labelled documents: clean ones stay, most bad ones go."""
    sf = "/root/testdata/sf0.01"
    out = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = out.where("not base_failed").select("quality", "kept").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_empty(spark):
    assert quality.judge(helpers.empty(spark)).count() == 0
