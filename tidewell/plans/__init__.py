"""Plans: the listing chain and the conformance queries."""
