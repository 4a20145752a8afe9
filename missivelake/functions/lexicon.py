"""Default word lists; every function that uses one takes it as a parameter."""

from __future__ import annotations

# Scores and lists must equal these for equal results.

#: Words with a valence from -3 to 3.
SENTIMENT: dict[str, int] = {
    **dict.fromkeys("love loved loving amazing awesome excellent fantastic perfect brilliant wonderful delighted ecstatic thrilled".split(), 3),
    **dict.fromkeys(
        "good great nice happy glad yes yay cool sweet excited congrats congratulations thanks thank appreciate proud hope hopeful fun enjoy enjoying "
        "enjoyed beautiful pretty lovely definitely sure absolutely".split(),
        2,
    ),
    **dict.fromkeys("ok okay alright fine decent agree yep yup yeah right smile smiling laugh laughing welcome please".split(), 1),
    **dict.fromkeys("eh meh whatever ugh nope nah tired sleepy bored annoyed annoying".split(), -1),
    **dict.fromkeys(
        "bad sad upset angry mad sorry guilty worried worry stress stressed frustrated frustrating hate hating dislike disappointed disappointing sick hurt "
        "hurting sucks suck broken broke lost losing failed failure wrong".split(),
        -2,
    ),
    **dict.fromkeys(
        "terrible awful horrible disgusting furious devastated crushed miserable nightmare worst hated hateful trauma traumatized depressed depression grief grieving".split(), -3
    ),
}

#: Words that turn the sign of a valence within the next three words.
NEGATORS: tuple[str, ...] = ("not", "no", "never", "nothing", "nobody", "nowhere")

#: Words that no phrase may hold, recurring or distinctive.
STOPWORDS: tuple[str, ...] = tuple(
    "a an and are as at be but by for from has have had he her him his how i if in is it its i'm i'll i've i'd me my no not of on or she so that the their "
    "them then there these they this to too was we were what when where which who why will with would you your yours you're you'll you've you'd u ur yeah "
    "yes yep yup ok okay oh uh um well just really very much lol lmao haha hahaha hi hey hello bye good got get go gonna going do does did done doing can "
    "could should would may might must let lets let's tell told say said see saw look know knew want need think thought make made take took give gave come "
    "came way thing things time day today tomorrow yesterday now later tonight morning night right wrong back out up down off over into after before again "
    "still even only also more most some any all every each other both few many such same own than next first last long new old big small little high low "
    "lot lots always never sometimes often usually almost".split()
)
