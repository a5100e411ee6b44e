"""Commands on reproductive cycles.

A cycle only moves forward: pending first check, provisional, confirmed, ended;
or empty, which is final.  Each phase therefore ends at the first command that
may end it, an aggregation, and the edits of a phase are those in between.  A
whole batch, many commands per cycle and cow included, is replayed in ``seq``
order by four phases, without gathering the commands of a cycle in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpoint, new_folder
from ..functions.ids import assign_ids
from ..functions.sequence import previous_value
from .changes import set_cow_state
from .commands import mark_missing

# The commands, the state each needs and the reasons for refusal.
NEEDS = {
    "editar_servicio": "Solo se puede editar el servicio si el ciclo está en Pendiente Palpación 1.",
    "registrar_palpacion1": 'El ciclo debe estar en "Pendiente Palpación 1" para realizar esta acción.',
    "editar_palpacion1": "Solo se puede editar Palpación 1 si el ciclo está en Preñez Provisional.",
    "registrar_palpacion2": 'El ciclo debe estar en "Preñez Provisional" para registrar Palpación 2.',
    "editar_palpacion2": "Solo se puede editar Palpación 2 si el ciclo está en Preñez Confirmada.",
    "registrar_parto": 'El ciclo debe estar en "Preñez Confirmada" para registrar un parto.',
    "editar_parto": "Solo se edita el parto si el ciclo ya finalizó.",
}
PHASE = {
    "editar_servicio": 0,
    "registrar_palpacion1": 0,
    "editar_palpacion1": 1,
    "registrar_palpacion2": 1,
    "editar_palpacion2": 2,
    "registrar_parto": 2,
    "editar_parto": 3,
}
BAD_CHECK = 'Resultado inválido. Utilice "Preñada" o "Vacía".'
BAD_BIRTH = 'Resultado inválido. Utilice "Exitoso" o "Abortado".'
FUTURE_START = "La fecha de inicio no puede ser futura."
BAD_DATE_1 = "Fecha de palpación inválida (debe ser posterior al servicio y no futura)."
BAD_DATE_2 = "La fecha debe ser posterior a la Palpación 1 y no futura."
BAD_DATE_3 = "Fecha de parto no puede ser anterior a Palpación 2 ni futura."
BUSY = "La vaca ya tiene un ciclo reproductivo activo."
CASCADE_START = (
    "Se recalcularon las fechas estimadas de palpación y parto, y se reprogramó la alerta de Palpación 1."
)
CASCADE_DATE_1 = "Se reprogramó la alerta de Palpación 2 basada en la nueva fecha de Palpación 1."
CASCADE_EMPTY_1 = (
    "Cambio de estado a Vacía. Se cancelaron alertas futuras y se creó Seguimiento de Celo. "
    "Vaca marcada como Vacía."
)
CASCADE_EMPTY_2 = "Cambio de estado a Vacía. Se canceló alerta Parto Estimado y creó Seguimiento de Celo."
CASCADE_ABORTED = "Cambio a Abortado. Requiere eliminar cría manualmente. Generada alerta de Celo."
CASCADE_BORN = "Cambio a Exitoso. Alerta de Celo cancelada. Ejecutar registro de cría manualmente."

_EXIT = "struct<seq:bigint,orden:string,fecha:date,resultado:string,id_veterinario:bigint,id_usuario:bigint>"
_EXIT_FIELDS = ("seq", "orden", "fecha", "resultado", "id_veterinario", "id_usuario")
_COMMAND = {
    "seq": "bigint",
    "id_ciclo": "bigint",
    "id_usuario": "bigint",
    "fecha": "date",
    "resultado": "string",
    "tipo_evento": "string",
    "id_veterinario": "bigint",
}
_ON = "seq > entra{p} AND (x{p} IS NULL OR seq < x{p}.seq)"
_NO_CYCLE = "ciclo inexistente"


def _add(df: DataFrame, **columns: str) -> DataFrame:
    return df.withColumns({name: F.expr(e) for name, e in columns.items()})


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class _Replay:
    """The state of one batch run: the cycles as they go through the phases."""

    def __init__(
        self, ciclo: DataFrame, orders: dict[str, DataFrame] | DataFrame, colaborador: DataFrame, as_of: str
    ):
        self.today = f"DATE '{as_of}'"
        self.columns = ciclo.columns
        if isinstance(orders, DataFrame):
            every = self._command("orden", orders.filter(F.col("orden").isin(*NEEDS)), colaborador)
            self.orders = {name: every.filter(F.col("orden") == name) for name in NEEDS}
        else:
            self.orders = {
                name: self._command(f"'{name}' AS orden", df, colaborador) for name, df in orders.items()
            }
            every = _union(list(self.orders.values())) if self.orders else None
        self.every, self.hopeless = every, None
        self.audits: list[DataFrame] = []
        start = "CASE WHEN estado_ciclo = '{}' THEN -1L END"
        self.cycles = _add(
            ciclo,
            entra0=start.format("Pendiente Palpación 1"),
            entra1=start.format("Preñez Provisional"),
            entra2=start.format("Preñez Confirmada"),
            entra3="CASE WHEN estado_ciclo IN ('Parto Exitoso', 'Abortado') THEN -1L END",
            cierra="CASE WHEN estado_ciclo IN ('Vacía', 'Parto Exitoso', 'Abortado') THEN -1L END",
        )

    @staticmethod
    def _command(name: str, df: DataFrame, colaborador: DataFrame) -> DataFrame:
        have = set(df.columns)
        df = df.selectExpr(
            name,
            *(f"CAST({c if c in have else 'NULL'} AS {type_}) AS {c}" for c, type_ in _COMMAND.items()),
        )
        return mark_missing(df, "id_veterinario", colaborador, "id_colaborador", "sin_vet")

    def candidates(self, name: str, valid: str, *columns: str) -> DataFrame | None:
        """Commands on a cycle that reaches their phase, before its end is known."""
        if name not in self.orders:
            return None
        phase = PHASE[name]
        cycles = self.cycles.select("id_ciclo", f"entra{phase}", *columns).filter(f"entra{phase} IS NOT NULL")
        return self.orders[name].join(cycles, "id_ciclo").filter(f"seq > entra{phase} AND ({valid})")

    def end_phase(self, phase: int, enders: list[DataFrame | None]) -> None:
        """Add ``x{phase}``: the first command that ends the phase of each cycle."""
        found = [df.select("id_ciclo", *_EXIT_FIELDS) for df in enders if df is not None]
        if not found:
            self.cycles = _add(self.cycles, **{f"x{phase}": f"CAST(NULL AS {_EXIT})"})
            return
        # Spread by ``seq``: the join before left all commands of a cycle in one task.
        first = (
            _union(found)
            .repartition("seq")
            .groupBy("id_ciclo")
            .agg(F.min_by(F.struct(*_EXIT_FIELDS), "seq").alias(f"x{phase}"))
        )
        self.cycles = self.cycles.join(first, "id_ciclo", "left")

    def within(self, phase: int, edits: DataFrame, *columns: str) -> DataFrame:
        """The edits given before their phase ended."""
        ends = self.cycles.select("id_ciclo", f"x{phase}", *columns)
        return edits.join(ends, "id_ciclo").filter(f"x{phase} IS NULL OR seq < x{phase}.seq").drop(f"x{phase}")

    def summarise(self, edits: DataFrame | None, **aggregates: tuple[str, str]) -> None:
        """Add per-cycle aggregates of edits; typed NULLs where there are none."""
        if edits is None:
            self.cycles = _add(self.cycles, **{n: f"CAST(NULL AS {t})" for n, (_, t) in aggregates.items()})
            return
        found = edits.groupBy("id_ciclo").agg(*(F.expr(e).alias(n) for n, (e, _) in aggregates.items()))
        self.cycles = self.cycles.join(found, "id_ciclo", "left")

    def audit(self, rows, phase_name, field, before, after, cascade="CAST(NULL AS STRING)") -> None:
        text = cascade if cascade.startswith("CAST") else f"'{cascade}'"
        self.audits.append(
            rows.selectExpr(
                "seq",
                "CAST(id_ciclo AS BIGINT) AS id_ciclo",
                "id_usuario",
                f"'{phase_name}' AS fase_editada",
                f"'{field}' AS campo_modificado",
                f"CAST({before} AS STRING) AS valor_anterior",
                f"CAST({after} AS STRING) AS valor_nuevo",
                f"{str(not cascade.startswith('CAST')).lower()} AS genero_cascada",
                f"{text} AS descripcion_cascada",
            )
        )

    # -- phases --

    def play(self) -> None:
        """Run the phases in order.

        A phase reads the cycles several times, so its plan must not hold the
        plan of the phase before: the cycles are written out in between.  Cycles
        that ended before the batch join in the last phase, empty ones in none,
        unless an id stands in rows of several states: then all rows take part.
        """
        busy = {PHASE[name] for name in self.orders}
        ended = idle = None
        if len(busy) > 1:
            alike = self.sort_out()
        if len(busy) > 1 and alike:
            none = "entra0 IS NULL AND entra1 IS NULL AND entra2 IS NULL"
            ended = self.cycles.filter(f"{none} AND entra3 IS NOT NULL")
            idle = self.cycles.filter(f"{none} AND entra3 IS NULL")
            self.cycles = self.cycles.filter(f"NOT ({none})")
        played = 0
        for number, phase in enumerate((self.service, self.first_check, self.second_check, self.birth)):
            if number in busy and played:
                self.cycles = checkpoint(self.cycles)
            if number == PHASE["editar_parto"] and ended is not None:
                self.cycles = self.cycles.unionByName(ended, allowMissingColumns=True)
            phase()
            played += number in busy
        if played > 1:
            self.cycles = checkpoint(self.cycles)
        # What can change; ``cycles`` also holds the rest, as the table has it.
        self.moved = self.cycles
        if idle is not None:
            self.cycles = self.cycles.unionByName(idle, allowMissingColumns=True)

    def sort_out(self) -> bool:
        """Write the commands that may take effect once, for all phases; ``hopeless`` are the others.

        True if the rows of each id, where it stands in several, begin in the same phase.

        A cycle only moves forward, so a command whose phase lies before the one its cycle is in at the
        start of the batch is refused whatever the others do; so is one on an empty cycle or on none.
        """
        begins = F.expr(
            "CASE WHEN entra0 IS NOT NULL THEN 0 WHEN entra1 IS NOT NULL THEN 1 "
            "WHEN entra2 IS NOT NULL THEN 2 WHEN entra3 IS NOT NULL THEN 3 END"
        )
        # An id may stand in several rows: a command is refused once for each of them.
        known = self.cycles.groupBy("id_ciclo").agg(
            F.min(begins).alias("_desde"),
            F.count("*").alias("_copias"),
            (F.count(begins).between(1, F.count("*") - 1) | (F.min(begins) < F.max(begins))).alias("_mezcla"),
        )
        mixed = known.filter("id_ciclo IS NOT NULL AND _mezcla")
        known = known.drop("_mezcla")
        phases = " ".join(f"WHEN '{name}' THEN {p}" for name, p in PHASE.items())
        needs = " ".join(f"WHEN '{name}' THEN '{text}'" for name, text in NEEDS.items())
        may = f"_desde <= CASE orden {phases} END"
        every, folder = self.every, new_folder(self.every.sparkSession, "commands")
        # The cycles are hashed: few numbers each, where sorting would take all commands.
        reached = known.filter("_desde IS NOT NULL").drop("_copias").hint("shuffle_hash")
        every.join(reached, "id_ciclo").filter(may).drop("_desde").write.partitionBy("orden").parquet(folder)
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in every.schema.fields)
        self.every = every.sparkSession.read.schema(types).parquet(folder)
        self.orders = {name: self.every.filter(F.col("orden") == name) for name in self.orders}
        self.hopeless = (
            every.select("seq", "orden", "id_ciclo")
            .join(known.hint("shuffle_hash"), "id_ciclo", "left")
            .filter(f"NOT coalesce({may}, false)")
            .selectExpr(
                "seq",
                "orden",
                f"if(_copias IS NULL, '{_NO_CYCLE}', CASE orden {needs} END) AS motivo",
                "explode(array_repeat(0, CAST(coalesce(_copias, 1) AS INT))) AS _copia",
            )
            .drop("_copia")
        )
        return mixed.isEmpty()

    def service(self) -> None:
        valid = f"fecha <= {self.today} AND tipo_evento IN ('Monta Natural', 'Inseminación Artificial') AND NOT sin_vet"
        edits = self.candidates("editar_servicio", valid)
        checks = self.candidates(
            "registrar_palpacion1", "resultado IN ('Preñada', 'Vacía') AND NOT sin_vet", "fecha_inicio"
        )
        if checks is not None and edits is not None:
            both = checks.unionByName(edits, allowMissingColumns=True)
            moved = F.expr("CASE WHEN orden = 'editar_servicio' THEN fecha END")
            both = previous_value(both, ["id_ciclo"], "seq", moved, "_movida")
            checks = _add(
                both.filter("orden = 'registrar_palpacion1'"), fecha_inicio="coalesce(_movida, fecha_inicio)"
            )
        if checks is not None:
            checks = checks.filter("fecha IS NULL OR fecha >= fecha_inicio")
        self.end_phase(0, [checks])
        if edits is not None:
            edits = self.within(
                0, edits, F.col("fecha_inicio").alias("fecha_ant"), F.col("tipo_evento").alias("tipo_ant")
            )
            edits = previous_value(edits, ["id_ciclo"], "seq", F.struct("fecha", "tipo_evento"), "_previa")
            edits = _add(
                edits,
                fecha_ant="coalesce(_previa.fecha, fecha_ant)",
                tipo_ant="coalesce(_previa.tipo_evento, tipo_ant)",
            )
            self.audit(
                edits.filter("fecha <> fecha_ant"), "Servicio", "fecha_inicio", "fecha_ant", "fecha", CASCADE_START
            )
            self.audit(
                edits.filter("tipo_evento <> tipo_ant"), "Servicio", "tipo_evento", "tipo_ant", "tipo_evento"
            )
        self.summarise(
            edits,
            e0=(
                "max_by(struct(fecha, tipo_evento, id_veterinario), seq)",
                "struct<fecha:date,tipo_evento:string,id_veterinario:bigint>",
            ),
            movida0=("bool_or(fecha <> fecha_ant)", "boolean"),
        )
        self.cycles = _add(
            self.cycles,
            fecha_inicio="coalesce(e0.fecha, fecha_inicio)",
            tipo_evento="coalesce(e0.tipo_evento, tipo_evento)",
            id_veterinario_inicio="if(e0 IS NULL, id_veterinario_inicio, e0.id_veterinario)",
            fecha_estimada_palp1="coalesce(date_add(e0.fecha, 30), fecha_estimada_palp1)",
            fecha_estimada_palp2="coalesce(date_add(e0.fecha, 60), fecha_estimada_palp2)",
            fecha_estimada_parto="coalesce(date_add(e0.fecha, 283), fecha_estimada_parto)",
            fecha_palpacion1="if(x0 IS NULL, fecha_palpacion1, x0.fecha)",
            resultado_palpacion1="coalesce(x0.resultado, resultado_palpacion1)",
            id_veterinario_palp1="if(x0 IS NULL, id_veterinario_palp1, x0.id_veterinario)",
            entra1="if(x0.resultado = 'Preñada', x0.seq, entra1)",
            cierra="if(x0.resultado = 'Vacía', x0.seq, cierra)",
        )

    def first_check(self) -> None:
        columns = ("fecha_inicio", "resultado_palpacion1", "fecha_palpacion1")
        dated = f"coalesce(fecha >= fecha_inicio AND fecha <= {self.today}, true) AND NOT sin_vet"
        edits = self.candidates("editar_palpacion1", dated, *columns)
        empties = "resultado_palpacion1 = 'Preñada' AND resultado = 'Vacía'"
        checks = self.candidates(
            "registrar_palpacion2",
            "resultado IN ('Preñada', 'Vacía') AND NOT sin_vet AND (fecha IS NULL OR fecha >= fecha_inicio)",
            "fecha_inicio",
        )
        cascades = None if edits is None else edits.filter(empties)
        self.end_phase(1, [checks, cascades])
        if edits is not None:
            minor = self.within(1, edits.filter(f"NOT coalesce({empties}, false)"))
            minor = previous_value(minor, ["id_ciclo"], "seq", F.col("fecha"), "_previa")
            minor = _add(
                minor,
                fecha_ant="CASE WHEN fecha_palpacion1 IS NOT NULL THEN coalesce(_previa, fecha_palpacion1) END",
            )
            self.audit(
                minor.filter("fecha <> fecha_ant"),
                "Palpación 1",
                "fecha_palpacion1",
                "fecha_ant",
                "fecha",
                CASCADE_DATE_1,
            )
            edits = minor
        self.summarise(
            edits,
            e1=("max_by(struct(id_veterinario), seq)", "struct<id_veterinario:bigint>"),
            movida1=("max_by(fecha, CASE WHEN fecha <> fecha_ant THEN seq END)", "date"),
        )
        emptied = "x1.orden = 'editar_palpacion1'"
        checked = "x1.orden = 'registrar_palpacion2'"
        if cascades is not None:
            self.audit(
                self.cycles.filter(emptied).selectExpr(
                    "id_ciclo", "x1.seq AS seq", "x1.id_usuario AS id_usuario", "resultado_palpacion1"
                ),
                "Palpación 1",
                "resultado_palpacion1",
                "resultado_palpacion1",
                "'Vacía'",
                CASCADE_EMPTY_1,
            )
        self.cycles = _add(
            self.cycles,
            fecha_palpacion1=f"if({emptied}, x1.fecha, coalesce(movida1, fecha_palpacion1))",
            resultado_palpacion1=f"if({emptied}, 'Vacía', resultado_palpacion1)",
            id_veterinario_palp1=f"if({emptied}, x1.id_veterinario, "
            "if(e1 IS NULL, id_veterinario_palp1, e1.id_veterinario))",
            fecha_estimada_palp2="coalesce(date_add(movida1, 30), fecha_estimada_palp2)",
            fecha_palpacion2=f"if({checked}, x1.fecha, fecha_palpacion2)",
            resultado_palpacion2=f"if({checked}, x1.resultado, resultado_palpacion2)",
            id_veterinario_palp2=f"if({checked}, x1.id_veterinario, id_veterinario_palp2)",
            entra2=f"if({checked} AND x1.resultado = 'Preñada', x1.seq, entra2)",
            cierra="if(x1.resultado = 'Vacía', x1.seq, cierra)",
        )

    def second_check(self) -> None:
        columns = ("fecha_inicio", "fecha_palpacion1", "resultado_palpacion2", "fecha_palpacion2")
        dated = (
            f"coalesce(fecha >= fecha_palpacion1, true) AND coalesce(fecha <= {self.today}, true) "
            "AND coalesce(fecha >= fecha_inicio, true)"
        )
        edits = self.candidates("editar_palpacion2", dated, *columns)
        empties = "resultado_palpacion2 = 'Preñada' AND resultado = 'Vacía'"
        births = self.candidates(
            "registrar_parto",
            "resultado IN ('Exitoso', 'Abortado') AND NOT sin_vet AND (fecha IS NULL OR fecha >= fecha_inicio)",
            "fecha_inicio",
        )
        cascades = None if edits is None else edits.filter(empties)
        self.end_phase(2, [births, cascades])
        if edits is not None:
            minor = self.within(2, edits.filter(f"NOT coalesce({empties}, false)"))
            minor = previous_value(minor, ["id_ciclo"], "seq", F.col("fecha"), "_previa")
            minor = _add(
                minor,
                fecha_ant="CASE WHEN fecha_palpacion2 IS NOT NULL THEN coalesce(_previa, fecha_palpacion2) END",
            )
            self.audit(
                minor.filter("fecha <> fecha_ant"), "Palpación 2", "fecha_palpacion2", "fecha_ant", "fecha"
            )
            edits = minor
        self.summarise(edits, movida2=("max_by(fecha, CASE WHEN fecha <> fecha_ant THEN seq END)", "date"))
        emptied = "x2.orden = 'editar_palpacion2'"
        born = "x2.orden = 'registrar_parto'"
        if cascades is not None:
            self.audit(
                self.cycles.filter(emptied).selectExpr(
                    "id_ciclo", "x2.seq AS seq", "x2.id_usuario AS id_usuario", "resultado_palpacion2"
                ),
                "Palpación 2",
                "resultado_palpacion2",
                "resultado_palpacion2",
                "'Vacía'",
                CASCADE_EMPTY_2,
            )
        self.cycles = _add(
            self.cycles,
            fecha_palpacion2=f"if({emptied}, x2.fecha, coalesce(movida2, fecha_palpacion2))",
            resultado_palpacion2=f"if({emptied}, 'Vacía', resultado_palpacion2)",
            fecha_parto_real=f"if({born}, x2.fecha, fecha_parto_real)",
            resultado_parto=f"if({born}, x2.resultado, resultado_parto)",
            id_veterinario_parto=f"if({born}, x2.id_veterinario, id_veterinario_parto)",
            entra3=f"if({born}, x2.seq, entra3)",
            cierra="coalesce(x2.seq, cierra)",
        )

    def birth(self) -> None:
        dated = f"coalesce(fecha >= fecha_palpacion2, true) AND coalesce(fecha <= {self.today}, true)"
        edits = self.candidates(
            "editar_parto", dated, "fecha_palpacion2", F.col("resultado_parto").alias("_base"), "id_animal"
        )
        self.flips = None
        if edits is not None:
            said = F.expr("CASE WHEN resultado = 'Exitoso' OR (resultado = 'Abortado' AND fecha IS NOT NULL) THEN resultado END")
            edits = previous_value(edits, ["id_ciclo"], "seq", said, "_previo")
            edits = _add(edits, previo="CASE WHEN _base IS NOT NULL THEN coalesce(_previo, _base) END")
            flips = edits.filter("resultado IN ('Exitoso', 'Abortado') AND resultado <> previo")
            self.undated = flips.filter("fecha IS NULL AND resultado = 'Abortado'").select("seq")
            self.flips = flips.filter("fecha IS NOT NULL OR resultado = 'Exitoso'")
            for result, text in (("Abortado", CASCADE_ABORTED), ("Exitoso", CASCADE_BORN)):
                self.audit(
                    self.flips.filter(f"resultado = '{result}'"),
                    "Parto",
                    "resultado_parto",
                    "previo",
                    "resultado",
                    text,
                )
        self.summarise(
            self.flips,
            x3=(
                "max_by(struct(seq, resultado), seq)",
                "struct<seq:bigint,resultado:string>",
            ),
            salva=("max(CASE WHEN resultado = 'Exitoso' THEN seq END)", "bigint"),
        )
        self.cycles = _add(
            self.cycles,
            resultado_parto="coalesce(x3.resultado, resultado_parto)",
            estado_ciclo="""CASE
                WHEN x3 IS NOT NULL THEN if(x3.resultado = 'Exitoso', 'Parto Exitoso', 'Abortado')
                WHEN x2.orden = 'registrar_parto' THEN if(x2.resultado = 'Exitoso', 'Parto Exitoso', 'Abortado')
                WHEN x2 IS NOT NULL OR x1.resultado = 'Vacía' OR x0.resultado = 'Vacía' THEN 'Vacía'
                WHEN x1 IS NOT NULL THEN 'Preñez Confirmada'
                WHEN x0 IS NOT NULL THEN 'Preñez Provisional'
                ELSE estado_ciclo END""",
        )

    # -- results --

    def rejected(self) -> DataFrame:
        """Commands without effect because the state, the date or the result forbids them."""
        timeline = ["entra0", "entra1", "entra2", "entra3", "x0", "x1", "x2"]
        kept = ["fecha_inicio", "fecha_palpacion1", "fecha_palpacion2"]
        cycles = self.cycles.select("id_ciclo", F.lit(True).alias("existe"), *timeline, *kept)
        today = self.today
        chk = "'fecha anterior al inicio del ciclo'"
        vet = "WHEN sin_vet THEN 'veterinario inexistente'"
        # ``fecha_palpacion1`` and ``fecha_palpacion2`` are final once the next phase begins.
        tests = {
            "editar_servicio": f"WHEN fecha > {today} THEN '{FUTURE_START}' "
            "WHEN fecha IS NULL THEN 'fecha de inicio ausente' "
            "WHEN tipo_evento IS NULL OR tipo_evento NOT IN ('Monta Natural', 'Inseminación Artificial') "
            f"THEN 'tipo de evento inválido' {vet}",
            "registrar_palpacion1": "WHEN resultado IS NULL OR resultado NOT IN ('Preñada', 'Vacía') "
            f"THEN '{BAD_CHECK}' {vet} WHEN x0 IS NULL OR seq < x0.seq THEN {chk}",
            "editar_palpacion1": f"WHEN fecha < fecha_inicio OR fecha > {today} THEN '{BAD_DATE_1}' {vet}",
            "registrar_palpacion2": "WHEN resultado IS NULL OR resultado NOT IN ('Preñada', 'Vacía') "
            f"THEN '{BAD_CHECK}' {vet} WHEN fecha < fecha_inicio THEN {chk}",
            "editar_palpacion2": f"WHEN fecha < fecha_palpacion1 OR fecha > {today} THEN '{BAD_DATE_2}' "
            f"WHEN fecha < fecha_inicio THEN {chk}",
            "registrar_parto": "WHEN resultado IS NULL OR resultado NOT IN ('Exitoso', 'Abortado') "
            f"THEN '{BAD_BIRTH}' {vet} WHEN fecha < fecha_inicio THEN {chk}",
            "editar_parto": f"WHEN fecha < fecha_palpacion2 OR fecha > {today} THEN '{BAD_DATE_3}'",
        }
        reasons = []
        for name in self.orders:
            p = PHASE[name]
            inside = f"seq > entra{p}" + (f" AND (x{p} IS NULL OR seq <= x{p}.seq)" if p < 3 else "")
            reasons.append(
                f"WHEN orden = '{name}' THEN CASE WHEN NOT coalesce({inside}, false) THEN '{NEEDS[name]}' "
                f"{tests[name]} END"
            )
        frames = [
            self.every.join(cycles, "id_ciclo", "left")
            .selectExpr(
                "seq", "orden", f"CASE WHEN existe IS NULL THEN '{_NO_CYCLE}' {' '.join(reasons)} END AS motivo"
            )
            .filter("motivo IS NOT NULL")
        ]
        if self.hopeless is not None:
            frames.append(self.hopeless)
        if "editar_parto" in self.orders:
            frames.append(
                self.undated.selectExpr("seq", "'editar_parto' AS orden", "'fecha de parto ausente' AS motivo")
            )
        return _union(frames)

    def new_alerts(self) -> DataFrame:
        """Alerts the accepted commands create, in the state later commands leave them."""
        heat = f"date_add({self.today}, 21)"
        entries = [
            ("x0.seq", "'Palpación 2'", "fecha_estimada_palp2", "if(x1 IS NULL, 'Pendiente', 'Completada')",
             "x0.resultado = 'Preñada'"),
            ("x0.seq", "'Seguimiento de Celo'", heat, "'Pendiente'", "x0.resultado = 'Vacía'"),
            ("x1.seq", "'Parto Estimado'", "fecha_estimada_parto",
             "CASE x2.orden WHEN 'registrar_parto' THEN 'Completada' WHEN 'editar_palpacion2' THEN 'Cancelada' "
             "ELSE 'Pendiente' END", "x1.orden = 'registrar_palpacion2' AND x1.resultado = 'Preñada'"),
            ("x1.seq", "'Seguimiento de Celo'", heat, "'Pendiente'", "x1.resultado = 'Vacía'"),
            ("x2.seq", "'Seguimiento de Celo'", heat, "if(salva IS NULL, 'Pendiente', 'Cancelada')",
             "x2.resultado IN ('Vacía', 'Abortado')"),
        ]
        structs = ", ".join(
            f"if({when}, struct({seq} AS seq, {kind} AS tipo_alerta, {day} AS fecha_programada, "
            f"{state} AS estado_alerta), NULL)"
            for seq, kind, day, state, when in entries
        )
        made = self.moved.selectExpr(
            "CAST(id_ciclo AS BIGINT) AS id_ciclo",
            "CAST(id_animal AS BIGINT) AS id_animal",
            f"inline(filter(array({structs}), a -> a IS NOT NULL))",
        )
        if self.flips is None:
            return made
        last = self.cycles.select("id_ciclo", "salva")
        aborted = self.flips.filter("resultado = 'Abortado'").join(last, "id_ciclo").selectExpr(
            "CAST(id_ciclo AS BIGINT) AS id_ciclo",
            "CAST(id_animal AS BIGINT) AS id_animal",
            "seq",
            "'Seguimiento de Celo' AS tipo_alerta",
            "date_add(fecha, 21) AS fecha_programada",
            "if(salva > seq, 'Cancelada', 'Pendiente') AS estado_alerta",
        )
        return made.unionByName(aborted)

    def updated_alerts(self, alertas: DataFrame) -> DataFrame:
        columns = alertas.columns
        facts = self.cycles.selectExpr(
            "id_ciclo",
            "if(movida0, date_add(fecha_inicio, 30), NULL) AS a_palp1",
            "date_add(movida1, 30) AS a_palp2",
            "x0 IS NOT NULL AS hecha1",
            "x1 IS NOT NULL AS hecha2",
            "x1.orden = 'editar_palpacion1' OR x2.orden = 'editar_palpacion2' AS anulada",
            "x2.orden = 'registrar_parto' AS nacida",
            "salva IS NOT NULL AS salvada",
        )
        open_ = "estado_alerta = 'Pendiente' AND tipo_alerta = "
        return _add(
            alertas.join(facts, "id_ciclo", "left"),
            fecha_programada=f"CASE WHEN {open_} 'Palpación 1' THEN coalesce(a_palp1, fecha_programada) "
            f"WHEN {open_} 'Palpación 2' THEN coalesce(a_palp2, fecha_programada) ELSE fecha_programada END",
            estado_alerta=f"""CASE
                WHEN {open_} 'Palpación 1' AND hecha1 THEN 'Completada'
                WHEN {open_} 'Palpación 2' AND hecha2 THEN 'Completada'
                WHEN {open_} 'Parto Estimado' AND nacida THEN 'Completada'
                WHEN {open_} 'Parto Estimado' AND anulada THEN 'Cancelada'
                WHEN {open_} 'Seguimiento de Celo' AND salvada THEN 'Cancelada'
                ELSE estado_alerta END""",
        ).select(columns)

    def cow_states(self) -> DataFrame:
        """The last state each cow took, over all her cycles."""
        changes = ", ".join(
            f"if({x} IS NULL, NULL, struct({x}.seq AS seq, {state} AS _vaca))"
            for x, state in (
                ("x0", "x0.resultado"),
                ("x1", "x1.resultado"),
                ("x2", "'Vacía'"),
                ("x3", "'Vacía'"),
            )
        )
        return (
            self.moved.selectExpr("id_animal", f"inline(filter(array({changes}), c -> c IS NOT NULL))")
            .groupBy("id_animal")
            .agg(F.max_by("_vaca", "seq").alias("_vaca"))
        )


def reproducir_ciclos(
    ciclo: DataFrame,
    alertas: DataFrame,
    vaca: DataFrame,
    colaborador: DataFrame,
    ordenes: dict[str, DataFrame] | DataFrame,
    as_of: str,
    inicios: DataFrame | None = None,
    animal: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Replay a batch of commands on existing cycles, and starts of new ones.

    ``ordenes`` maps a command of ``NEEDS`` to its requests, or holds the requests of all seven with the
    command in a column ``orden``, others being left out; ``inicios`` holds the requests for new cycles.
    ``seq`` is unique over all of them.
    """
    run = _Replay(ciclo, ordenes, colaborador, as_of)
    run.play()
    cycles = run.cycles.select(run.columns)
    created = run.new_alerts()
    rejected = [run.rejected()] if run.orders else []
    if inicios is not None:
        started, refused = _start(run.cycles, ciclo, inicios, animal, colaborador)
        cycles = cycles.unionByName(started.drop("seq"), allowMissingColumns=True).select(run.columns)
        created = created.unionByName(
            started.selectExpr(
                "seq",
                "id_ciclo",
                "id_animal",
                "'Palpación 1' AS tipo_alerta",
                "fecha_estimada_palp1 AS fecha_programada",
                "'Pendiente' AS estado_alerta",
            )
        )
        rejected.append(refused)
    numbered = assign_ids(created, "seq", "id_alerta", alertas, "id_alerta").drop("seq")
    out = {
        "tbl_ciclo_reproductivo": cycles,
        "tbl_alerta_reproductiva": run.updated_alerts(alertas).unionByName(numbered, allowMissingColumns=True),
        "tbl_vaca_detalle": set_cow_state(vaca, run.cow_states()),
        "rechazadas": _union(rejected),
    }
    if run.audits:
        out["tbl_auditoria_ciclo"] = _union(run.audits).drop("seq")
    return out


def _start(
    cycles: DataFrame, ciclo: DataFrame, inicios: DataFrame, animal: DataFrame, colaborador: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The first valid request of each cow after her last cycle closed starts a cycle."""
    closed = cycles.groupBy("id_animal").agg(
        F.max("cierra").alias("libre"), F.count_if(F.col("cierra").isNull()).alias("activos")
    )
    asked = mark_missing(inicios, "id_animal", animal, "id_animal", "sin_animal")
    asked = mark_missing(asked, "id_veterinario", colaborador, "id_colaborador", "sin_vet")
    asked = asked.join(closed, "id_animal", "left").withColumn(
        "motivo",
        F.expr(
            f"""CASE WHEN activos > 0 OR seq < libre THEN '{BUSY}'
                WHEN sin_animal OR id_animal IS NULL THEN 'animal inexistente'
                WHEN fecha_inicio IS NULL THEN 'fecha de inicio ausente'
                WHEN tipo_evento IS NULL OR tipo_evento NOT IN ('Monta Natural', 'Inseminación Artificial')
                    THEN 'tipo de evento inválido'
                WHEN sin_vet THEN 'veterinario inexistente' END"""
        ),
    )
    valid = asked.filter("motivo IS NULL")
    claims = valid.select("id_animal", "seq").repartition("seq")
    first = claims.groupBy("id_animal").agg(F.min("seq").alias("_primera"))
    valid = valid.join(first, "id_animal")
    accepted = assign_ids(valid.filter("seq = _primera"), "seq", "id_ciclo", ciclo, "id_ciclo")
    # Once a cycle has started, every later request of the cow finds it active.
    late = asked.join(first, "id_animal", "left").withColumn(
        "motivo", F.expr(f"CASE WHEN seq > _primera THEN '{BUSY}' ELSE motivo END")
    )
    started = accepted.selectExpr(
        "seq",
        "id_ciclo",
        "id_animal",
        "fecha_inicio",
        "tipo_evento",
        "CAST(id_veterinario AS BIGINT) AS id_veterinario_inicio",
        "date_add(fecha_inicio, 30) AS fecha_estimada_palp1",
        "date_add(fecha_inicio, 60) AS fecha_estimada_palp2",
        "date_add(fecha_inicio, 283) AS fecha_estimada_parto",
        "'Pendiente Palpación 1' AS estado_ciclo",
    )
    refused = late.filter("motivo IS NOT NULL").selectExpr("seq", "'iniciar_ciclo' AS orden", "motivo")
    return started, refused
