from oracles import checks, explore, live, marts, models, questions

ORACLES = {
    **marts.ORACLES, **questions.ORACLES, **explore.ORACLES, **checks.ORACLES, **models.ORACLES, **live.ORACLES,
}
