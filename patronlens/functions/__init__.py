"""Column helpers shared by every operator; all of them stay inside the JVM."""
