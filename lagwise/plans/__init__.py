"""Wiring: the two scoring plans, their models, the blend and the registered queries."""
