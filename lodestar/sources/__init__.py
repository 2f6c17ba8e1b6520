"""Where an index comes from."""
