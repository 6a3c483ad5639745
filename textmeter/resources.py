"""Word lists, thresholds and published constants.

Nothing here is derived; these are the literal values results depend on.
Word-level lexicons (valence, polarity, lemmas) are *not* here: they are
tables the caller passes in, because the published ones hold thousands of rows.
"""

# ---------------------------------------------------------------------------
# Words that carry negation. They survive stop-word removal and
# are what the negation count looks for.
# ---------------------------------------------------------------------------
NEGATION_WORDS = (
    "no", "not", "nor", "never", "nobody", "nothing", "nowhere",
    "neither", "hardly", "barely", "scarcely",
    "cannot", "cant", "wont", "dont", "doesnt", "didnt",
    "wasnt", "werent", "isnt", "arent", "shouldnt", "wouldnt", "couldnt",
)

# ---------------------------------------------------------------------------
# Contracted form -> expansion. Case-sensitive, straight
# apostrophe only, whole words only.
# ---------------------------------------------------------------------------
CONTRACTIONS = {
    "don't": "do not", "Don't": "do not",
    "doesn't": "does not", "Doesn't": "does not",
    "didn't": "did not", "Didn't": "did not",
    "won't": "will not", "Won't": "will not",
    "can't": "cannot", "Can't": "cannot",
    "cannot": "cannot",
    "isn't": "is not", "Isn't": "is not",
    "aren't": "are not", "Aren't": "are not",
    "wasn't": "was not", "Wasn't": "was not",
    "weren't": "were not", "Weren't": "were not",
    "wouldn't": "would not", "Wouldn't": "would not",
    "couldn't": "could not", "Couldn't": "could not",
    "shouldn't": "should not", "Shouldn't": "should not",
    "hasn't": "has not", "Hasn't": "has not",
    "haven't": "have not", "Haven't": "have not",
    "hadn't": "had not", "Hadn't": "had not",
    "I'm": "I am", "I've": "I have", "I'll": "I will", "I'd": "I would",
    "they're": "they are", "they've": "they have", "they'll": "they will",
    "it's": "it is", "he's": "he is", "she's": "she is",
}

# Words the tokenizer splits in two, and where.
TOKEN_SPLITS = {
    "cannot": ("can", "not"),
    "gimme": ("gim", "me"),
    "gonna": ("gon", "na"),
    "gotta": ("got", "ta"),
    "lemme": ("lem", "me"),
    "wanna": ("wan", "na"),
}

# ---------------------------------------------------------------------------
# The common English stop list (the published 179-word list).
# ---------------------------------------------------------------------------
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so
than too very s t can will just don don't should should've now d ll m o re ve
y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't
shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn
wouldn't
""".split())

# The list cleaning really drops: stop words, except those that negate.
STOP_WORDS = tuple(w for w in ENGLISH_STOP_WORDS if w not in NEGATION_WORDS)

# Words whose presence in a text may give the label away.
LEAKAGE_WORDS = ("positive", "negative", "label", "sentiment")

# Realism gate.
MIN_ROWS = 40_000
MIN_AVG_WORDS = 50
MIN_VOCABULARY = 5_000

# Audit thresholds.
AUDIT_VOCABULARY_CRITICAL = 500
AUDIT_VOCABULARY_WARNING = 5_000
AUDIT_MIN_MEAN_WORDS = 30
AUDIT_TOP_TOKENS = 15
BALANCE_RANGE = (0.85, 1.15)
PERFECT_SCORE = 0.999

# Feature and split defaults.
SEED = 42
TEST_SHARE = 0.2
MAX_FEATURES = 10_000
MIN_DF = 2
WORD2VEC_DIM = 100
WORD2VEC_WINDOW = 5
WORD2VEC_EPOCHS = 10
FEATURE_SETS = ("BoW", "TF-IDF", "Word2Vec", "Hybrid")
LEXICON_COLUMNS = ("compound", "pos", "neg", "neu", "polarity", "subjectivity")

# The results table, in column order.
RATIO_METRICS = (
    "Accuracy", "Precision", "Recall", "F1-Score", "MCC", "Sensitivity",
    "Specificity", "FPR", "FNR", "NPV", "FDR",
)
COUNT_METRICS = ("TP", "TN", "FP", "FN")
RESULT_COLUMNS = ("Model", "Features") + RATIO_METRICS
COMPARED_METRICS = ("Accuracy", "Precision", "Recall", "F1-Score", "MCC")

# ---------------------------------------------------------------------------
# Constants of the published rule-based valence scorer.
# ---------------------------------------------------------------------------
BOOST = 0.293
CAPITALS_BOOST = 0.733
NEGATION_FACTOR = -0.74
DISTANCE_DAMPING = (1.0, 0.95, 0.9)
NEVER_SO_FACTOR = 1.25
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
COMPOUND_ALPHA = 15.0
EXCLAMATION_WEIGHT, EXCLAMATION_MAX = 0.292, 4
QUESTION_WEIGHT, QUESTION_MAX, QUESTION_CAP = 0.18, 3, 0.96

VALENCE_NEGATORS = tuple("""
aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't
daren't didn't doesn't dont hadnt hasnt havent isnt mightnt mustnt neither
don't hadn't hasn't haven't isn't mightn't mustn't neednt needn't never none
nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent oughtn't
shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't wouldn't
rarely seldom despite
""".split())

VALENCE_INCREASERS = tuple("""
absolutely amazingly awfully completely considerable considerably decidedly
deeply effing enormous enormously entirely especially exceptional
exceptionally extreme extremely fabulously flipping flippin frackin fracking
fricking frickin frigging friggin fully fuckin fucking fuggin fugging greatly
hella highly hugely incredible incredibly intensely major majorly more most
particularly purely quite really remarkably so substantially thoroughly total
totally tremendous tremendously uber unbelievably unusually utter utterly very
""".split())

VALENCE_DECREASERS = tuple("""
almost barely hardly kinda kindof kind-of less little marginal marginally
occasional occasionally partly scarce scarcely slight slightly somewhat sorta
sortof sort-of
""".split())

VALENCE_DECREASING_PAIRS = ("kind of", "sort of", "just enough")

VALENCE_IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5,
    "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5,
    "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9,
}

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Negation words and factor of the published polarity scorer.
POLARITY_NEGATORS = ("no", "not", "n't", "never")
POLARITY_NEGATION_FACTOR = -0.5

# Rows of the data summary, in order.
SUMMARY_LABELS = (
    "Total Reviews", "Positive Reviews", "Negative Reviews", "Avg Length (Positive)", "Avg Length (Negative)",
    "Max Length (Positive)", "Max Length (Negative)", "Min Length (Positive)", "Min Length (Negative)",
)
