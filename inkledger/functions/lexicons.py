"""Word lists, patterns and thresholds of the integrity signals. Results depend on them as they stand."""

from __future__ import annotations

from dataclasses import dataclass

AI_PATTERNS = [
    r"\bstress in education\b", r"\barises because students\b", r"\bconstant pressure to perform\b", r"\bperform well in exams\b",
    r"\bmeet dead[\s-]?lines\b", r"\bbalance multiple subjects\b", r"\bfear of failure\b", r"\bcomparison with peers\b",
    r"\bhigh expectations from (teachers|family)\b", r"\bchallenges feel overwhelming\b", r"\bfeel overwhelming\b", r"\black of control\b",
    r"\bover outcomes\b", r"\buncertainty about\b", r"\bfuture opportunities\b", r"\bintensify stress\b", r"\boutcomes intensify\b",
    r"\bcompetition lack\b", r"\bface constant pressure\b", r"\bfurthermore\b", r"\bmoreover\b", r"\bin conclusion\b",
    r"\bit is important to note\b", r"\bit is worth noting\b", r"\bas mentioned (above|earlier|previously)\b", r"\bin summary\b", r"\bto summarize\b",
    r"\bplays a (crucial|key|vital|pivotal) role\b", r"\bit is essential (to|that)\b", r"\bin addition\b", r"\badditionally\b", r"\bconsequently\b",
    r"\bthus,\b", r"\btherefore,\b", r"\bhence,\b", r"\bnevertheless\b", r"\bnonetheless\b", r"\bon the other hand\b", r"\bin contrast\b",
    r"\bas a result\b", r"\bdue to (the|this|these)\b", r"\bit should be noted\b", r"\bit can be (seen|observed)\b", r"\bone can (observe|see|note)\b",
    r"\bin the context of\b", r"\bwith respect to\b", r"\bsignificantly\b", r"\bsubstantially\b", r"\bcomprehensively\b", r"\beffectively ensures?\b",
    r"\bvarious aspects\b", r"\bdiverse range\b", r"\bkey (aspects|elements|components|factors)\b", r"\bdelve into\b", r"\bshed light on\b",
    r"\bundeniably\b", r"\bindisputably\b", r"\bultimately,\b", r"\boverall,\b", r"\bit goes without saying\b", r"\bpivotal (role|aspect|element)\b",
    r"\brobust (approach|framework|system|solution)\b", r"\bseamlessly\b", r"\boptimal(ly)?\b", r"\bsynergistic\b", r"\bparadigm\b",
]

STUDENT_PATTERNS = [
    r"\bi think\b", r"\bi believe\b", r"\bi feel\b", r"\bwe (know|learned|studied|saw)\b", r"\blet me (explain|show|calculate)\b", r"\bthe answer is\b",
    r"\bso,?\s+we\b", r"\bfor example,?\s+if\b", r"\blike\s+we\b", r"\bas we\b", r"\bfirst(ly)?,?\s+we\b", r"\bnext,?\s+we\b", r"\bfinally,?\s+we\b",
    r"\bthen\s+we\b", r"\bcan't\b", r"\bwon't\b", r"\bdon't\b", r"\bgot\b", r"\bkinda\b", r"\bpretty\s+much\b",
]

AI_MARKERS = [
    "furthermore", "moreover", "in conclusion", "it is important to note", "it is worth noting", "as mentioned", "in summary", "to summarize",
    "plays a crucial role", "it is essential", "in addition", "additionally", "consequently", "thus", "therefore", "hence", "nevertheless", "nonetheless",
    "on the other hand", "in contrast", "as a result", "due to this", "it should be noted", "it can be seen", "one can observe", "in the context of",
    "with respect to", "in terms of", "significantly", "substantially", "comprehensively", "effectively", "various aspects", "multifaceted",
    "diverse range", "key aspects", "delve into", "shed light on", "pivotal role", "undeniable", "at the end of the day", "it goes without saying",
]

HUMAN_MARKERS = [
    "i think", "i believe", "i feel", "we know", "we can see", "as we learned", "like we studied", "the answer is", "because", "so", "then", "also",
    "but", "since", "when", "if", "let me", "first", "next", "finally", "another", "example",
]

STYLE_STOPWORDS = """a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could
should may might it its this that these those i we you he she they my your his her our their me him us them not no""".split()

COPY_STOPWORDS = """the a an and or but in on at to for of with by from is are was were be have has had do does did will would could should may
might it its this that these those not no as if so we you he she they i my your his her our their me him us them very also just get like can
about because when what""".split()

BURST_STOPWORDS = "the a an and or is in of to it this that was".split()

FORMAL_WORDS = """furthermore moreover consequently therefore nevertheless subsequently simultaneously aforementioned regarding predominantly
intensify uncertainty overwhelm overwhelming arises constant pressure multiple balance deadlines expectations comparison opportunities competition
outcomes""".split()

INFORMAL_WORDS = "we our i my us we're i'm me mug marks force bad different like things just also but so then and".split()

COLLOQUIAL_WORDS = "mug marks force bad things".split()

PUNCTUATION = list(".,;:!?-–—()\"'")


@dataclass(frozen=True)
class Profile:
    """Thresholds of one detector generation."""

    ai_high: float
    ai_low: float | None
    text_high: float
    text_moderate: float | None
    same_writer: float
    same_student_guard: bool


LIVE = Profile(ai_high=0.40, ai_low=0.28, text_high=0.55, text_moderate=0.40, same_writer=0.75, same_student_guard=False)
PEER = Profile(ai_high=0.55, ai_low=None, text_high=0.40, text_moderate=None, same_writer=0.75, same_student_guard=True)
PEER_ALT = Profile(ai_high=0.65, ai_low=None, text_high=0.60, text_moderate=None, same_writer=0.92, same_student_guard=False)
