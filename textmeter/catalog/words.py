"""Small word tables for the registered queries.

The test texts are invented prose, so these terms are words that occur in it;
real runs pass their own lexicons.
"""

# Fixed values: (term, valence).
VALENCE = (
    ("worthless", -1.9), ("pathetic", -2.1), ("stupid", -2.4), ("trash", -1.5),
    ("idiot", -2.3), ("disgusting", -2.4), ("no", -1.2), ("hehely", 1.9),
    ("inoran", 2.2), ("orantion", 1.3), ("ononst", -1.1), ("thatin", 0.8),
    ("rewh", -0.7), ("onou", 1.6), ("heed", 0.9), ("eaea", -1.4),
)
# Words treated as boosters and negators in the queries.
BOOSTERS = {"the": 0.293, "and": 0.293, "la": 0.293, "of": -0.293, "de": -0.293}
NEGATORS = ("in", "is", "que", "not", "never")

# Fixed values: (term, polarity, subjectivity, intensity or None).
POLARITY = (
    ("worthless", -0.8, 0.9, None), ("pathetic", -1.0, 1.0, None), ("stupid", -0.8, 1.0, None),
    ("trash", -0.5, 0.6, None), ("hehely", 0.5, 0.6, None), ("inoran", 0.7, 0.4, None),
    ("thatin", 0.3, 0.2, None), ("the", 0.1, 0.2, 1.3), ("of", 0.0, 0.1, 0.8), ("rewh", -0.4, 0.5, None),
)
POLARITY_NEGATORS = ("in", "is", "not", "never")

# Words the leakage query looks for.
LEAKAGE = ("worthless", "stupid", "pathetic", "sentiment")

# Words of the test texts and the contracted form put in their place,
# since the texts hold no contractions of their own.
PLANTED = (
    (" the ", " don't "), (" of ", " Can't "), (" and ", " I'm "), (" to ", " they've "),
    (" in ", " WON'T "), (" is ", " it's "), (" that ", " Hadn't "), (" for ", " cannot "),
    (" on ", " she's "), (" was ", " won't "), (" with ", " they'll "), (" de ", " I'd "),
)
