"""Values that decide results and therefore must be exactly these."""

# --- Fixed values -------------------------------------------------------------------------------

# Emotion order of every seven-value probability vector, and the column each one is stored in.
EMOTIONS = ["기쁨", "당황", "분노", "슬픔", "혐오", "공포", "평상"]
EMOTION_FIELDS = [
    "joy_pct", "embarrass_pct", "anger_pct", "sadness_pct", "disgust_pct", "fear_pct", "neutral_pct",
]
EMOTION_OFFICIAL_NAMES = [
    "기쁨/행복/환호", "당황/놀람", "분노/짜증", "슬픔/좌절", "혐오/불쾌", "공포/불안", "중립/일상",
]
EMOTION_COLORS = {
    "기쁨": "#FF8A3D", "당황": "#8C6FFF", "분노": "#E5484D", "슬픔": "#5B8DB8",
    "혐오": "#4FAE7A", "공포": "#4C9AFF", "평상": "#6B6478",
}
NEUTRAL = "평상"
LEGACY_NEUTRAL = "중립"
NO_SPEECH_TEXT = "(음성 발화 없음)"

# Words and patterns of the context rules.
NEGATIVE_WORDS = [
    "에휴", "멍청", "노답", "망했", "개못", "발컨", "벌레", "트롤",
    "아니", "왜저", "답답", "극혐", "까비", "뇌절", "똥싸", "역겹",
]
POSITIVE_WORDS = ["나이스", "대박", "와", "지렸다", "레전드", "갓", "폼미쳤", "캐리"]
JOY_PATTERN = "ㅋ|ㅎ|ㄲ|캬|크"
SAD_PATTERN = "ㅠ|ㅜ|ㄱ-|ㅡㅡ"
SURPRISE_PATTERN = r"\?|!|ㄷ|헐|엥|오"

# Words and vectors of the guardrails.
QUESTION_WORDS = ["오바", "진짜", "대박", "뭐하", "이게", "헐", "엥", "레전드", "나가"]
CHEER_WORD = "대박"
ANGER_WORDS = ["빡치", "뇌절", "개못하"]
DISGUST_WORDS = ["더럽", "찝찝", "토나오", "극혐"]
ONLY_QUESTION_VECTOR = [0.05, 0.85, 0.02, 0.02, 0.02, 0.02, 0.02]
ONLY_EXCLAMATION_VECTOR = [0.85, 0.05, 0.02, 0.02, 0.02, 0.02, 0.02]

# Text quality.
NOISE_CHARS = "+-=;_~`|"
SINGLE_CHAR_WORDS = [
    "못", "안", "왜", "네", "예", "그", "저", "이", "참", "자", "야",
    "흠", "오", "와", "헐", "흥", "게", "좀", "또", "쫌", "헉", "칫",
]
SLANG_PATTERN = "^[ㅋㅎㅠㅜㄷㅗㅇㄴㄱ]{2,}$"
SYLLABLE_CLASS = "[가-힣]"
LETTER_CLASS = "[가-힣ㄱ-ㅎㅏ-ㅣ]"
REPEAT_PUNCTUATION = ".,!?~…·'\"()[]{}<>-:;"

# Text column names, best first.
TEXT_COLUMN_NAMES = ["chat_text", "sentence", "text", "chat", "document", "content", "발화"]

# Platforms by host part, in test order.
PLATFORM_HOSTS = [
    ("youtube", ["youtube.com", "youtu.be"]),
    ("chzzk", ["chzzk.naver.com"]),
    ("soop", ["sooplive.co.kr", "sooplive.com", "afreecatv.com"]),
]

# Job states.
ACTIVE_STATES = ["queued", "downloading", "analyzing"]
RESTART_MESSAGE = "서버가 다시 시작되어 분석이 중단됐어요. 다시 분석해 주세요."

# Score grades (lowest score, name) and message tiers.
GRADES = [(98, "레전드 웃음"), (84, "빵 터진 웃음"), (69, "웃음 포인트"), (0, "잔잔한 웃음")]
MESSAGE_TIERS = [80, 60, 40]

# Abramowitz-Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]

# Relative times and elapsed times.
AGE_NOW = "방금 전"
AGE_MINUTES, AGE_HOURS, AGE_DAYS = "%d분 전", "%d시간 전", "%d일 전"
ELAPSED_MINUTES, ELAPSED_SECONDS = "%d분 %d초", "%d초"

# What the context rules add or take.
MOCKING_SHIFT, MOCKING_JOY_LOSS = 0.35, 0.25
MOCKING_TO_ANGER, MOCKING_TO_EMBARRASSED = 0.7, 0.3
NEGATIVE_SHIFT = 0.4
SHIFT_PER_SIGN = 0.15
MOST_CHEER, MOST_SAD, MOST_SURPRISE = 0.50, 0.45, 0.40
LEAST_LEFT, LEAST_PROBABILITY = 0.01, 0.001

# Least probability a guardrail gives its label.
GUARD_QUESTION, GUARD_CHEER, GUARD_ANGER, GUARD_DISGUST = 0.75, 0.85, 0.80, 0.80

# Region by majority vote: thirds of the screen, what belongs to the chosen third, and margins.
VOTE_LEFT, VOTE_RIGHT = 0.35, 0.65
VOTE_RIGHT_FROM, VOTE_LEFT_TO, VOTE_MIDDLE = 0.55, 0.45, (0.30, 0.70)
VOTE_MARGIN_X, VOTE_MARGIN_Y = 0.03, 0.05
VOTE_LEAST_BOXES = 3

# Weighted fusion of window totals: usual and quiet-but-intense weights of chat, sound and screen.
WEIGHTS, QUIET_WEIGHTS = (0.4, 0.3, 0.3), (0.6, 0.1, 0.3)
QUIET_BELOW, INTENSE_ABOVE, FULL_CHAT = 0.3, 0.5, 20.0

# Chat region used when too few boxes are seen: (ymin, xmin, ymax, xmax).
DEFAULT_REGION = (0.15, 0.65, 0.95, 0.98)

# First part of a job id, before the time it was handed in.
JOB_PREFIX = "wbb"

# --- End of fixed values --------------------------------------------------------------------------
