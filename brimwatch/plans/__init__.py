"""Multi-operator plans (scoring cycle, triage) and the registered queries."""
