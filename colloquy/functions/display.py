"""What readers see: dates, times, shares and short sentences made from figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_up
from .text import with_particle

#: Fixed names of the days, Monday first.
WEEKDAYS = ("월요일", "화요일", "수요일", "목요일", "금요일", "토요일", "일요일")
#: Fixed units in which the samples of the metrics are counted.
SAMPLE_UNITS = {
    "msgCount": "메시지",
    "msgLength": "메시지",
    "questionRate": "버스트",
    "syncAsym": "전환 쌍",
    "styleSep": "화자당 메시지",
    "replyDist": "전환 쌍",
    "initiation": "세션",
    "noReply": "세션",
    "monthly": "개월",
    "changePoint": "개월",
    "phraseGap": "화자당 메시지",
    "deletedCount": "메시지",
    "emojiAffect": "이모티콘",
    "emojiVariety": "이모티콘",
}
#: Fixed phrases for a percentage, each from its lower bound on.
PERCENT_PHRASES = ((80, "이건 뭐, 끝났죠"), (62, "반응 오는데요? 조금만 더"), (45, "아직 아무도 안 졌어요"), (38, "슬슬 기울고 있어요"), (25, "음, 당신이 좀 더 뛰고 있어요"))
LEAST_PHRASE = "혼자 열심히시네요…"


def display_time(time: Column) -> Column:
    """HH:mm on a clock of twelve hours; null for anything else."""
    hour = F.regexp_extract(time, r"\A(\d{1,2}):(\d{2})\z", 1).try_cast("int")
    half = F.when(hour < 12, "오전").otherwise("오후")
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.when(hour.isNotNull(), F.concat(half, F.lit(" "), twelve.cast("string"), F.lit(":"), F.right(time, F.lit(2))))


def display_date(date: Column) -> Column:
    """YYYY-MM-DD with the name of its day."""
    d = date.try_cast("date")
    day = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(d) + 1)
    return F.concat(F.year(d).cast("string"), F.lit("년 "), F.month(d).cast("string"), F.lit("월 "), F.dayofmonth(d).cast("string"), F.lit("일 "), day)


def month_span(first: Column, last: Column) -> Column:
    """Calendar months from one YYYY-MM-DD to another, both included."""
    part = lambda d, i: F.split(d, "-").getItem(i).cast("int")
    return (part(last, 0) - part(first, 0)) * 12 + part(last, 1) - part(first, 1) + 1


def share_percent(me: Column, other: Column) -> Column:
    """My share of two sizes as a whole percentage, 50 if both are 0."""
    total = F.abs(me) + F.abs(other)
    return F.when(total == 0, 50).otherwise(half_up(F.abs(me) / total * 100)).cast("int")


def percent_phrase(percent: Column) -> Column:
    out = F.lit(LEAST_PHRASE)
    for least, phrase in reversed(PERCENT_PHRASES):
        out = F.when(percent >= least, phrase).otherwise(out)
    return out


def hard_floor_sentence(fact: Column) -> Column:
    return F.coalesce(F.concat(F.lit("이 대화에서 확실히 말할 수 있는 것 하나 — "), fact), F.lit("판독할 만큼의 대화가 모이지 않았습니다."))


def status_message(metric: Column, status: Column) -> Column:
    """What a closed gate says: null for an open one, what to add, or how much is missing of which sample."""
    unit = F.element_at(F.create_map(*[F.lit(x) for pair in SAMPLE_UNITS.items() for x in pair]), metric)
    have, need = (F.regexp_extract(status, r"\AINSUFFICIENT:([0-9.]+)/([0-9]+)\z", i) for i in (1, 2))
    short = F.concat(with_particle(unit, "이", "가"), F.lit(" 더 필요합니다 ("), F.floor(have.try_cast("double")).cast("string"), F.lit(" / "), need, F.lit(")"))
    missing = F.split(F.regexp_replace(status, r"\ALOCKED:", ""), ",")
    locked = F.when(F.array_contains(missing, "affect"), "캡처를 올리면 열립니다").otherwise("전체 대화 파일을 넣으면 열립니다")
    return F.when(F.startswith(status, F.lit("LOCKED:")), locked).when(F.startswith(status, F.lit("INSUFFICIENT:")), short)
