"""Plans that combine operators into whole runs."""
