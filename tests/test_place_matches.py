"""Messages and the places they share words with: counted between word sets, with ids that repeat or are missing."""

import collections
import re

from roamlens.operators import messages


def test_shared_words_by_word_sets(spark):
    says = [(1, "a large hotel and resort near beach"), (2, "resort resort beach"), (2, "beach hotel"), (3, "nothing shared"), (4, "blue beach resort please"), (None, "hotel"), (5, None)]
    named = [(1, "Beach Hotel"), (2, "Hotel Beach"), (3, "Blue Beach Resort"), (4, "Inn"), (5, "Beach Beach"), (6, None), (7, "Hotel"), (7, "Beach Resort"), (None, "Resort")]
    got = messages.place_matches(spark.createDataFrame(says, "message_id long, message string"), spark.createDataFrame(named, "place_id long, place_name string"))
    words = lambda t, n: {w for w in re.findall(r"[a-z']+", (t or "").lower()) if len(w) > n}
    want, strong = collections.Counter(), set()
    for m, text in says:
        for p, name in named:
            if m is not None and name and text and name.lower() in text.lower():  # a message without an id is not looked up
                strong.add((m, p, 100))
            if shared := words(text, 3) & words(name, 3):
                want[m, p] += len(shared)
    covered = {(m, p) for m, p, _ in strong if m is not None and p is not None}
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [*strong, *((m, p, n) for (m, p), n in want.items() if (m, p) not in covered)]))
    # No pair of a message and a place is counted by key: pairs are only made.
    assert not re.search(r"Aggregate \[message_id#\d+L?, place_id#\d+L?\]", got._jdf.queryExecution().optimizedPlan().toString())
