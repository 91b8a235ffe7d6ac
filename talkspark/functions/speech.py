"""Part-of-speech features around an injected tagger, in Arrow batches; without a tagger they are left out."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from talkspark.functions.text import PAUSE

# Tags that carry content, and the names of the features.
CONTENT = ("NOUN", "PROPN", "VERB", "ADJ", "ADV")
FEATURES = ("lexical_density", "phrasal_verb_ratio", "pronoun_ratio")
# End of fixed values.
#: A tagger: a text to (word, tag, dependency, tag of the head) of each token.
Tagger = Callable[[str], list[tuple[str, str, str, str]]]


def ratios(tokens: list[tuple[str, str, str, str]]) -> dict[str, float]:
    tags = [tag for word, tag, _, _ in tokens if word.isalpha()]
    if not tags:
        return dict.fromkeys(FEATURES, 0.0)
    verbs = sum(tag == "VERB" for _, tag, _, _ in tokens)
    particles = sum(dep == "prt" and head == "VERB" for _, _, dep, head in tokens)
    return {"lexical_density": sum(t in CONTENT for t in tags) / len(tags), "phrasal_verb_ratio": particles / verbs if verbs else 0.0, "pronoun_ratio": sum(t == "PRON" for t in tags) / len(tags)}


def speech_features(tagger: Callable[[], Tagger]) -> Callable[[Column], dict[str, Column]]:
    """For the ``more`` of the statistics: ``tagger`` makes the tagger once for each batch of texts, where it runs."""

    @F.pandas_udf(f"struct<{','.join(f'{k}:double' for k in FEATURES)}>")
    def tag(texts: pd.Series) -> pd.DataFrame:
        run = tagger()
        return pd.DataFrame([ratios(run(t)) for t in texts.fillna("")], columns=list(FEATURES))

    def more(body: Column) -> dict[str, Column]:
        found = tag(F.regexp_replace(body, PAUSE, ""))
        return {k: found[k] for k in FEATURES}

    return more
