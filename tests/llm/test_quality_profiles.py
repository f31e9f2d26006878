import random

from quillmesh.llm.quality import PRIORS, fit_profiles, fitted_profiles, largest_part, statistics

PROSE = {
    "ru": "Вчера вечером в городе состоялось большое собрание жителей, на котором обсуждали строительство новой школы. По словам организаторов, проект поддержали почти все участники, хотя некоторые высказали сомнения.",
    "zh": "昨天晚上，城市里举行了一次居民大会，讨论了新学校的建设问题。组织者表示，几乎所有参与者都支持这个项目，尽管有些人表示怀疑。会议持续了三个小时，最后通过了决议。",
    "ar": "عقد سكان المدينة مساء أمس اجتماعا كبيرا لمناقشة بناء مدرسة جديدة في الحي القديم. وقال المنظمون إن معظم المشاركين أيدوا المشروع، على الرغم من أن بعضهم أعرب عن شكوكه.",
    "ta": "நேற்று மாலை நகரத்தில் புதிய பள்ளியைக் கட்டுவது குறித்து விவாதிக்க ஒரு பெரிய கூட்டம் நடைபெற்றது. பெரும்பாலான பங்கேற்பாளர்கள் திட்டத்தை ஆதரித்தனர் என்று ஏற்பாட்டாளர்கள் தெரிவித்தனர்.",
    "ja": "昨日の夜、町で大きな集会が開かれ、新しい学校の建設について話し合われました。主催者によると、ほとんどの参加者が計画を支持しましたが、一部の人は疑問を示しました。",
    "ko": "어제 저녁 도시에서 새로운 학교 건설에 대해 논의하기 위한 큰 모임이 열렸습니다. 주최 측에 따르면 거의 모든 참가자가 이 계획을 지지했지만 일부는 의문을 제기했습니다.",
    "it": "Ieri sera in città si è tenuta una grande riunione degli abitanti per discutere la costruzione di una nuova scuola. Secondo gli organizzatori quasi tutti i partecipanti hanno sostenuto il progetto, anche se alcuni hanno espresso dubbi.",
}
JUNK = "xkq zzvw plom qirt bnaz wexu traz olpq vuin mnax qwer zopl trew bvcx nmlk poiu hgfd saqw zxcv lkjh mnbv qazx swed"


def test_prose_of_any_script_is_prose():
    assert {k: statistics(t)["kind"] for k, t in PROSE.items()} == dict.fromkeys(PROSE, "prose")


def test_words_without_grammar_and_marks_are_junk():
    assert statistics(JUNK)["kind"] == "junk"
    assert statistics("@@ ## $$ %% ^^ && ** (( )) ++ == ~~ `` @@! #$% ^&* <<>> [][] {}{}")["kind"] == "junk"


def test_few_labels_change_profiles_little_and_many_follow_them():
    mixed = lambda n: [(largest_part(" ".join(random.Random(i).sample(JUNK.split(), 20))), "junk") for i in range(n)]
    few, many = fit_profiles(mixed(2)), fit_profiles(mixed(400))
    name = max(PRIORS, key=lambda n: abs(many[n].chars[1] - PRIORS[n].chars[1]))
    at = [p[name].chars[1] for p in (PRIORS, few, many)]
    assert abs(at[1] - at[0]) < 0.2 * abs(at[2] - at[0]) and many[name].kind == "junk"
    assert fit_profiles([]) == PRIORS and fit_profiles([(largest_part(""), "junk"), (largest_part(" "), "prose")]) == PRIORS
    assert all(statistics(t, many)["kind"] == "prose" for t in PROSE.values())


def test_profiles_are_fitted_to_a_bounded_number_of_labels(spark):
    docs = spark.createDataFrame([(i, JUNK + f" w{i}", "x") for i in range(60)] + [(60, None, "x"), (61, " ", "x")], "doc_id long, text string, kind string")
    labels = spark.createDataFrame([(i, "junk") for i in range(62)] + [(3, "table"), (None, "junk"), (5, None), (99, "list")], "doc_id long, kind string")
    assert fitted_profiles(docs, labels.limit(0)) == PRIORS
    few, many = fitted_profiles(docs, labels, most=5), fitted_profiles(docs, labels)
    assert few != PRIORS and few != many and few == fitted_profiles(docs, labels, most=5)
