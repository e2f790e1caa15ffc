"""Configuration, rubric compiler, workflow, registered queries."""
