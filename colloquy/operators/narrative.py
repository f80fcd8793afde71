"""Checks of a sentence written about a conversation, and the block of numbers it is written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import shown
from ..functions.text import sentence_count, unknown_numbers, with_particle

MAX_SENTENCES = 2

#: Fixed lists of words that a sentence about a chat must not use.
BANNED = {
    "word": ("포기", "가망", "그만두", "손절", "아깝"),
    "prediction": ("이어질", "잘 될", "잘될", "가능성이", "확률", "전망"),
    "advice": ("힘드셨", "해보세요", "하세요", "추천", "걱정하지", "괜찮아질"),
    "scope": ("평생", "항상", "한 번도", "단 한 번"),
}


def banned_words(text: Column) -> Column:
    """kind:word of each listed word in a text."""
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(w).alias("word")) for k, words in BANNED.items() for w in words])
    return F.transform(F.filter(listed, lambda x: F.contains(text, x["word"])), lambda x: F.concat_ws(":", x["kind"], x["word"]))


def verified(sentences: DataFrame, text: str = "text", numbers: str = "numbers") -> DataFrame:
    """Adds unknown numbers, banned words, sentence count and whether a sentence may be shown."""
    t = F.col(text)
    out = sentences.withColumns({"unknown": unknown_numbers(t, F.col(numbers)), "banned": banned_words(t), "sentences": sentence_count(t)})
    return out.withColumn("ok", (F.size("unknown") == 0) & (F.size("banned") == 0) & F.col("sentences").between(1, MAX_SENTENCES))


#: Fixed sentences of the bands, in general and before two have become a pair.
BAND_LABELS = {
    "strong_me": "이 대화는 당신 쪽으로 뚜렷하게 기울어 있습니다",
    "lean_me": "당신 쪽으로 기울어 있습니다",
    "even": "한쪽으로 기울었다고 보기 어렵습니다",
    "lean_other": "상대 쪽으로 기울어 있습니다",
    "strong_other": "이 대화는 상대 쪽으로 뚜렷하게 기울어 있습니다",
}
CRUSH_LABELS = {
    "strong_me": "당신이 훨씬 더 많이 다가가고 있습니다",
    "lean_me": "당신 쪽에서 더 다가가고 있습니다",
    "even": "양쪽이 비슷하게 주고받고 있습니다",
    "lean_other": "상대 쪽에서 더 다가오고 있습니다",
    "strong_other": "상대가 훨씬 더 많이 다가오고 있습니다",
}
#: Fixed lines of the block: each with the columns whose values stand in its gaps, in order.
HIDDEN_TILT = "# 표본이 얇아 기울기 숫자는 확정하지 않았다. 문장에 기울기 수치를 쓰지 마라."
VALUE_LINES = (
    ("메시지 수: 당신 {} / 상대 {}", "count_me", "count_other"),
    ("평균 글자 수: 당신 {} / 상대 {}", "length_me", "length_other"),
    ("질문 비율: 당신 {} / 상대 {}   # 0~1, 높을수록 자주 묻는다", "question_me", "question_other"),
    ("먼저 말 건 비율: 당신 {}% / 상대 {}%   # 세션 {}개 기준", "initiation_me", "initiation_other", "initiation_sessions"),
    ("무응답률: 당신 {}% / 상대 {}%   # 높을수록 답이 안 온다", "noreply_me", "noreply_other"),
    ("이모티콘 정서: 당신 {} / 상대 {}   # -1(부정) ~ +1(긍정)", "affect_me", "affect_other"),
    ("말투 분리도: {}   # 0~100, 높을수록 다르게 말한다", "style_score"),
)
DERIVED_HEAD = "# 아래는 위 값에서 계산해 둔 것이다. 그대로 인용하라."
DERIVED_LINES = (
    ("메시지 점유율: 당신 {}% / 상대 {}%", "share_me", "share_other"),
    ("평균 길이 차: {}자", "length_gap"),
    ("질문 비율 차: {}%p", "question_gap"),
    ("먼저 말 건 비율(높은 쪽): {}%", "initiation_top"),
    ("무응답률(높은 쪽): {}%", "noreply_top"),
    ("이모티콘 온도차: {}", "affect_gap"),
)


def band_label(band: Column, crush: bool = False) -> Column:
    labels = CRUSH_LABELS if crush else BAND_LABELS
    return F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), band)


def filled(line: str, *columns: str) -> Column:
    """A line with the values of its columns in its gaps, null if one of them is."""
    parts = line.split("{}")
    values = [shown(F.col(c)) for c in columns]
    return F.concat(F.lit(parts[0]), *[x for v, p in zip(values, parts[1:], strict=True) for x in (v, F.lit(p))])


def metric_block(r: DataFrame, crush: bool = False) -> DataFrame:
    """(chat, block): the lines that a sentence is written from, out of one row a chat with headline, values and figures.

    A value that is missing has no line, columns that ``r`` lacks count so, and a coarse headline tells
    its direction without a number. Values that follow from others stand below them, so that nobody has to compute.
    """
    way = F.when(F.col("tilt") > 0, "당신 쪽").when(F.col("tilt") < 0, "상대 쪽").otherwise("균형")
    there = lambda lines: [filled(*line) for line in lines if set(line[1:]) <= set(r.columns)]
    head = [
        F.when(F.col("coarse"), F.concat(F.lit("기울기 방향: "), way, F.lit(f"\n{HIDDEN_TILT}"))).otherwise(filled("기울기: {}   # -100(상대 쪽) ~ +100(당신 쪽), 0이 균형", "tilt")),
        F.concat(F.lit("판정: "), band_label(F.col("band"), crush), F.lit("   # 완결된 문장이다. 그대로 쓰거나 안 쓴다")),
        filled("근거 축: {}개 / {}개", "axes_used", "axes_total"),
        filled("표본: 최근 {}개 메시지", "window_filled"),
    ]
    derived = F.concat_ws("\n", *there(DERIVED_LINES))
    return r.select("chat", F.concat_ws("\n", *head, *there(VALUE_LINES), F.when(derived != "", F.concat(F.lit(f"\n{DERIVED_HEAD}\n"), derived))).alias("block"))


def share_phrase(who: Column, percent: Column) -> Column:
    """'who + particle percent%' with the particle that the name takes."""
    return F.concat(with_particle(who, "이", "가"), F.lit(" "), percent.cast("string"), F.lit("%"))
