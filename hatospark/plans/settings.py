"""Business dates the registered queries run at."""

AS_OF = "1998-06-01"
RUN_TS = "1998-06-01 00:00:00"
AUDITOR = "app@localhost"
