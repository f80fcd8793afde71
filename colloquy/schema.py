"""The message row that all sources give and all operators take, and shared limits."""

from __future__ import annotations

#: chat: key of a conversation; seq: dense order from 0; who: me or other; ts: epoch
#: milliseconds in UTC; date YYYY-MM-DD; time HH:mm; type: one of TYPES.
MESSAGES = (
    "chat long, seq long, who string, ts long, date string, time string, type string, text string, "
    "char_count int, emoji_desc string, valence double, intensity double, confidence double"
)
TYPES = ("text", "photo", "emoticon", "file", "voice", "deleted", "nontext")

WINDOW = 120
SESSION_GAP_MS = 6 * 60 * 60 * 1000
HARD_FLOOR = 10
