"""The tables of the data model: columns, keys, references and row rules.

Names, types, lengths, domains and references are fixed values.  The first
column of a table is its primary key, and every reference points at the
primary key of its parent.
"""

from __future__ import annotations

from pyspark.sql import types as T

from . import domains as D
from .columns import (
    AS_OF,
    CASCADE,
    RESTRICT,
    RUN_TS,
    SET_NULL,
    Table,
    amount,
    big,
    choice,
    clock,
    day,
    flag,
    integer,
    key,
    moment,
    ref,
    stamp,
    text,
)

INT, LONG = T.IntegerType(), T.LongType()
SIX_DIGITS = "^[0-9]{6}$"


def _animal_ref(name="id_animal", on_delete=CASCADE, null=False, **kw):
    return ref(name, "tbl_animal", on_delete, null, **kw)


def _user_ref(name="id_usuario"):
    return ref(name, "tbl_usuario", SET_NULL, null=True)


def _vet_ref(name):
    return ref(name, "tbl_colaborador", RESTRICT, null=True, update_cascades=False)


_CREATED = stamp("fecha_creacion")

_PEOPLE = [
    Table(
        "tbl_rol",
        (
            key("id_rol", INT),
            text("nombre_rol", 50),
            text("descripcion", 255, null=True),
            flag("activo", True),
            _CREATED,
        ),
        unique=(("nombre_rol",),),
    ),
    Table(
        "tbl_usuario",
        (
            key("id_usuario", INT),
            text("usuario", 50),
            text("email", 120),
            text("password_hash", 255),
            text("nombre_completo", 120),
            text("telefono", 25, null=True),
            ref("id_rol", "tbl_rol", RESTRICT),
            choice("estado", D.ESTADO_USUARIO, "activo"),
            moment("ultimo_login", null=True),
            _CREATED,
            stamp("fecha_modif"),
        ),
        unique=(("usuario",), ("email",)),
    ),
    Table(
        "tbl_colaborador",
        (
            key("id_colaborador", INT),
            _user_ref(),
            text("nombre", 120),
            text("telefono", 25, null=True),
            text("correo", 120, null=True),
            ref("id_rol", "tbl_rol", RESTRICT),
            choice("estado", D.ESTADO_COLABORADOR, "activo"),
            text("notas", null=True),
            day("fecha_ingreso", default=AS_OF),
            _CREATED,
        ),
    ),
]

_CATALOGUES = [
    Table(
        "tbl_raza",
        (
            key("id_raza", INT),
            text("nombre_raza", 60),
            choice("proposito", D.PROPOSITO_RAZA, "Doble Propósito"),
            text("descripcion", 255, null=True),
            flag("activo", True),
        ),
        unique=(("nombre_raza",),),
    ),
    Table(
        "tbl_procedencia",
        (key("id_procedencia", INT), text("nombre", 60), text("descripcion", 255, null=True)),
        unique=(("nombre",),),
    ),
    Table(
        "tbl_manga",
        (
            key("id_manga", INT),
            integer("numero_manga"),
            text("nombre", 60),
            choice("funcion", D.FUNCION_MANGA),
            integer("capacidad_max", default=0),
            flag("activo", True),
            _CREATED,
        ),
        unique=(("numero_manga",),),
    ),
    Table(
        "tbl_causa",
        (
            key("id_causa", INT),
            choice("causa_principal", D.CAUSA_PRINCIPAL),
            text("detalle_causa", 255, null=True),
            flag("activo", True),
            _CREATED,
        ),
    ),
]

_ANIMALS = [
    Table(
        "tbl_animal",
        (
            key("id_animal", INT),
            ref("id_procedencia", "tbl_procedencia", SET_NULL, null=True),
            ref("id_raza", "tbl_raza", RESTRICT),
            ref("id_manga_actual", "tbl_manga", SET_NULL, null=True),
            text("trazabilidad", 20),
            choice("tipo_animal", D.TIPO_ANIMAL),
            choice("sexo", D.SEXO),
            text("arete", 50),
            day("fecha_nacimiento"),
            day("fecha_ingreso", default=AS_OF),
            amount("peso_actual_kg", 7, 2, null=True),
            choice("estado_animal", D.ESTADO_ANIMAL, "Activo"),
            text("foto_url", 255, null=True),
            text("observaciones", null=True),
            _CREATED,
            stamp("fecha_modificacion"),
        ),
        unique=(("trazabilidad",), ("arete",)),
        checks={"chk_trazabilidad": f"trazabilidad RLIKE '{SIX_DIGITS}'"},
    ),
    Table(
        "tbl_vaca_detalle",
        (
            key("id_vaca_detalle"),
            _animal_ref(),
            choice("estado_ordeno", D.ESTADO_ORDENO, "Activo"),
            choice("estado_reproductivo", D.ESTADO_REPRODUCTIVO, "Vacía"),
            day("fecha_inicio", default=AS_OF),
            day("fecha_fin", null=True),
            flag("es_vigente", True),
            text("observaciones", null=True),
            _CREATED,
        ),
    ),
    Table(
        "tbl_toro_detalle",
        (
            key("id_toro_detalle"),
            _animal_ref(),
            choice("tipo_uso", D.TIPO_USO, "Semental"),
            flag("activo_reproduccion", True),
            day("fecha_inicio_reprod", null=True),
            choice("libido_evaluacion", D.LIBIDO, "Sin evaluar"),
            flag("es_vigente", True),
            day("fecha_inicio", default=AS_OF),
            day("fecha_fin", null=True),
            _user_ref("id_usuario_registro"),
            _CREATED,
        ),
    ),
    Table(
        "tbl_toro_monta_natural",
        (
            key("id_monta_natural"),
            ref("id_toro_detalle", "tbl_toro_detalle", CASCADE, type=LONG),
            integer("num_montas_acumuladas", default=0),
            day("fecha_inicio_monta", null=True),
            text("observaciones", null=True),
            _CREATED,
        ),
        unique=(("id_toro_detalle",),),
    ),
    Table(
        "tbl_toro_inseminacion",
        (
            key("id_inseminacion"),
            ref("id_toro_detalle", "tbl_toro_detalle", CASCADE, type=LONG),
            text("codigo_envase", 6),
            text("observaciones", null=True),
            flag("activo", True),
            _CREATED,
        ),
        unique=(("codigo_envase",),),
        checks={"chk_codigo_envase": f"codigo_envase RLIKE '{SIX_DIGITS}'"},
    ),
    Table(
        "tbl_ternero_detalle",
        (
            key("id_ternero_detalle"),
            _animal_ref(),
            _animal_ref("id_madre", SET_NULL, null=True),
            _animal_ref("id_padre", SET_NULL, null=True),
            amount("peso_nacimiento_kg", 6, 2, null=True),
            amount("peso_destete_kg", 6, 2, null=True),
            amount("ganancia_diaria_kg", 5, 3, null=True),
            choice("estado_lactancia", D.ESTADO_LACTANCIA, "Lactante"),
            day("fecha_destete", null=True),
            text("observaciones", null=True),
            flag("es_vigente", True),
            day("fecha_inicio", default=AS_OF),
            day("fecha_fin", null=True),
            _CREATED,
        ),
    ),
    Table(
        "tbl_animal_auditoria",
        (
            key("id_auditoria"),
            _animal_ref(),
            choice("accion", D.ACCION_ANIMAL),
            text("estado_anterior", 50, null=True),
            text("estado_nuevo", 50, null=True),
            text("motivo", 255, null=True),
            text("observaciones", null=True),
            day("fecha_evento"),
            _CREATED,
        ),
    ),
    Table(
        "tbl_movimiento_manga",
        (
            key("id_movimiento"),
            _animal_ref(),
            ref("id_manga_origen", "tbl_manga", SET_NULL, null=True),
            ref("id_manga_destino", "tbl_manga", RESTRICT),
            text("motivo", 255, null=True),
            moment("fecha_movimiento", default=RUN_TS),
            _user_ref(),
            text("observaciones", null=True),
            _CREATED,
        ),
    ),
    Table(
        "tbl_pesaje",
        (
            key("id_pesaje"),
            _animal_ref(),
            day("fecha_pesaje"),
            clock("hora_pesaje"),
            amount("peso_kg", 7, 2),
            text("observaciones", null=True),
            _user_ref(),
            _CREATED,
        ),
        checks={"chk_peso_kg": "peso_kg > 0"},
    ),
    Table(
        "tbl_produccion_leche",
        (
            key("id_produccion"),
            _animal_ref(),
            day("fecha_ordeno"),
            amount("litros_manana", 6, 2, default=0),
            amount("litros_tarde", 6, 2, default=0),
            amount("total_litros", 6, 2, null=True),
            text("observaciones", null=True),
            _CREATED,
        ),
        unique=(("id_animal", "fecha_ordeno"),),
        generated={"total_litros": ("litros_manana + litros_tarde", "decimal(6,2)")},
    ),
]

_HEALTH = [
    Table(
        "tbl_producto_sanitario",
        (
            key("id_producto", INT),
            text("nombre", 120),
            choice("tipo", D.TIPO_PRODUCTO),
            text("unidad_medida", 20, null=True),
            text("descripcion", 255, null=True),
            flag("activo", True),
            _CREATED,
        ),
        unique=(("nombre", "tipo"),),
    ),
    Table(
        "tbl_registro_sanitario",
        (
            key("id_registro_san"),
            choice("tipo_aplicacion", D.TIPO_APLICACION, "Individual"),
            choice("categoria", D.CATEGORIA_SANITARIA),
            text("sub_tipo", 80, null=True),
            choice("proposito", D.PROPOSITO_SANITARIO, null=True),
            ref("id_producto", "tbl_producto_sanitario", SET_NULL, null=True),
            amount("dosis_valor", 8, 2, null=True),
            choice("dosis_unidad", D.DOSIS_UNIDAD, null=True),
            day("fecha_aplicacion"),
            clock("hora_aplicacion"),
            choice("repeticion", D.REPETICION, "Única"),
            integer("intervalo_dias", null=True),
            integer("duracion_dias", null=True),
            ref("id_causa", "tbl_causa", SET_NULL, null=True),
            text("responsable", 120, null=True),
            text("notas", null=True),
            ref("id_veterinario", "tbl_colaborador", SET_NULL, null=True),
            _user_ref(),
            _CREATED,
        ),
    ),
    Table(
        "tbl_registro_sanitario_animal",
        (
            key("id_detalle"),
            ref("id_registro_san", "tbl_registro_sanitario", CASCADE, type=LONG),
            _animal_ref(),
            choice("estado_aplicacion", D.ESTADO_APLICACION, "Pendiente"),
            moment("fecha_real_aplicacion", null=True),
            text("observacion", 155, null=True),
            _CREATED,
        ),
        unique=(("id_registro_san", "id_animal"),),
    ),
    Table(
        "tbl_mastitis_cuartos",
        (
            key("id_mastitis"),
            ref("id_registro_san", "tbl_registro_sanitario", CASCADE, type=LONG),
            _animal_ref(),
            *(choice(f"cuarto_{q}", D.CUARTO, "Sana") for q in ("ad", "pd", "ai", "pi")),
            text("notas_diagnostico", null=True),
            flag("en_tratamiento", False),
            _CREATED,
        ),
    ),
    Table(
        "tbl_programacion_sanitaria",
        (
            key("id_programacion"),
            ref("id_registro_san", "tbl_registro_sanitario", CASCADE, type=LONG),
            moment("fecha_programada"),
            choice("estado", D.ESTADO_PROGRAMACION, "Pendiente"),
            text("observaciones", null=True),
            _CREATED,
        ),
    ),
    Table(
        "tbl_detalle_aplicacion_sanitaria",
        (
            key("id_aplicacion"),
            ref("id_registro_san", "tbl_registro_sanitario", CASCADE, type=LONG),
            _animal_ref(),
            amount("dosis_valor", 8, 2),
            choice("dosis_unidad", D.DOSIS_UNIDAD),
            choice("via_aplicacion", D.VIA_APLICACION, null=True),
            amount("peso_animal_kg", 7, 2, null=True),
            moment("fecha_aplicacion"),
            text("aplicada_por", 120, null=True),
            flag("reaccion_adversa", False),
            text("descripcion_reaccion", 255, null=True),
            text("observaciones", null=True),
            _CREATED,
        ),
    ),
]

_REPRODUCTION = [
    Table(
        "tbl_ciclo_reproductivo",
        (
            key("id_ciclo", INT),
            _animal_ref(on_delete=RESTRICT, update_cascades=False),
            day("fecha_inicio"),
            choice("tipo_evento", D.TIPO_EVENTO),
            _vet_ref("id_veterinario_inicio"),
            day("fecha_estimada_palp1"),
            day("fecha_estimada_palp2"),
            day("fecha_estimada_parto"),
            choice("estado_ciclo", D.ESTADO_CICLO, "Pendiente Palpación 1"),
            day("fecha_palpacion1", null=True),
            choice("resultado_palpacion1", D.RESULTADO_PALPACION, null=True),
            _vet_ref("id_veterinario_palp1"),
            day("fecha_palpacion2", null=True),
            choice("resultado_palpacion2", D.RESULTADO_PALPACION, null=True),
            _vet_ref("id_veterinario_palp2"),
            day("fecha_parto_real", null=True),
            choice("resultado_parto", D.RESULTADO_PARTO, null=True),
            _vet_ref("id_veterinario_parto"),
            stamp("created_at", null=True),
        ),
        checks={
            "chk_fecha_p1": "fecha_palpacion1 >= fecha_inicio",
            "chk_fecha_p2": "fecha_palpacion2 >= fecha_inicio",
            "chk_fecha_parto": "fecha_parto_real >= fecha_inicio",
        },
    ),
    Table(
        "tbl_alerta_reproductiva",
        (
            key("id_alerta"),
            ref("id_ciclo", "tbl_ciclo_reproductivo", CASCADE, update_cascades=False),
            _animal_ref(on_delete=RESTRICT, update_cascades=False),
            choice("tipo_alerta", D.TIPO_ALERTA_REPRODUCTIVA),
            day("fecha_programada"),
            choice("estado_alerta", D.ESTADO_ALERTA_REPRODUCTIVA, "Pendiente"),
            stamp("created_at", null=True),
        ),
    ),
]

_EXITS = [
    Table(
        "tbl_mortalidad",
        (
            key("id_mortalidad"),
            _animal_ref(on_delete=RESTRICT),
            ref("id_causa", "tbl_causa", RESTRICT),
            day("fecha_muerte"),
            stamp("fecha_registro"),
            text("observacion", null=True),
            _user_ref(),
        ),
        unique=(("id_animal",),),
    ),
    Table(
        "tbl_baja_animal",
        (
            key("id_baja"),
            _animal_ref(on_delete=RESTRICT),
            choice("tipo_baja", D.TIPO_BAJA, "Venta"),
            ref("id_causa", "tbl_causa", SET_NULL, null=True),
            day("fecha_baja"),
            amount("precio_venta", 12, 2, null=True),
            text("comprador", 120, null=True),
            text("observacion", null=True),
            _user_ref(),
            _CREATED,
        ),
        unique=(("id_animal",),),
    ),
]

_SUPPLIES = [
    Table(
        "tbl_categoria_insumo",
        (
            key("id_categoria_insumo", INT),
            text("nombre_categoria", 80),
            text("descripcion", 255, null=True),
            flag("activo", True),
            _CREATED,
        ),
        unique=(("nombre_categoria",),),
    ),
    Table(
        "tbl_insumo",
        (
            key("id_insumo", INT),
            ref("id_categoria_insumo", "tbl_categoria_insumo", RESTRICT),
            text("nombre", 120),
            text("unidad", 20),
            text("icono", 60, null=True),
            amount("stock_actual", 10, 2, default=0),
            amount("stock_minimo", 10, 2, default=0),
            flag("activo", True),
            _CREATED,
        ),
        unique=(("nombre",),),
    ),
    Table(
        "tbl_movimiento_insumo",
        (
            key("id_mov_insumo"),
            ref("id_insumo", "tbl_insumo", RESTRICT),
            choice("tipo_movimiento", D.TIPO_MOVIMIENTO),
            choice("destino_venta", D.DESTINO_VENTA, null=True),
            amount("cantidad", 10, 2),
            amount("precio_unitario", 10, 2, null=True),
            amount("total", 12, 2, null=True),
            text("cliente", 120, null=True),
            text("proveedor", 120, null=True),
            text("factura_url", 255, null=True),
            day("fecha_movimiento"),
            text("observaciones", null=True),
            _user_ref(),
            _CREATED,
        ),
        checks={"chk_cantidad": "cantidad > 0"},
        generated={"total": ("cantidad * coalesce(precio_unitario, 0)", "decimal(12,2)")},
    ),
    Table(
        "tbl_produccion_concentrado_det",
        (
            key("id_detalle"),
            ref("id_mov_insumo", "tbl_movimiento_insumo", CASCADE, type=LONG),
            ref("id_insumo_usado", "tbl_insumo", RESTRICT),
            amount("cantidad_usada", 10, 2),
        ),
    ),
]

_FINANCE = [
    Table(
        "tbl_transaccion_financiera",
        (
            key("id_transaccion"),
            choice("categoria", D.CATEGORIA_FINANCIERA),
            day("fecha_transaccion"),
            text("concepto", 120),
            text("descripcion", null=True),
            amount("monto", 12, 2),
            choice("estado", D.ESTADO_TRANSACCION, "ejecutado"),
            text("url_factura", 2083, null=True),
            _user_ref(),
            _CREATED,
            choice("tipo_origen", D.TIPO_ORIGEN, "Manual"),
            ref("id_mov_insumo", "tbl_movimiento_insumo", SET_NULL, null=True, type=LONG),
        ),
        checks={"chk_monto": "monto >= 0"},
    ),
    Table(
        "tbl_transaccion_animal",
        (
            key("id_trans_animal"),
            ref("id_transaccion", "tbl_transaccion_financiera", CASCADE, type=LONG),
            ref("id_baja", "tbl_baja_animal", RESTRICT, type=LONG),
            amount("precio_acordado", 12, 2, default=0),
            amount("comision_pct", 5, 2, default=0),
            amount("comision_monto", 12, 2, null=True),
            amount("neto_recibido", 12, 2, null=True),
            text("notas", 255, null=True),
            _CREATED,
        ),
        generated={
            "comision_monto": ("precio_acordado * comision_pct / 100", "decimal(12,2)"),
            "neto_recibido": (
                "precio_acordado - precio_acordado * comision_pct / 100",
                "decimal(12,2)",
            ),
        },
    ),
    Table(
        "tbl_transaccion_leche",
        (
            key("id_trans_leche"),
            ref("id_transaccion", "tbl_transaccion_financiera", CASCADE, type=LONG),
            day("fecha_inicio"),
            day("fecha_fin"),
            amount("total_litros", 10, 2, default=0),
            amount("precio_litro", 8, 4, default=0),
            amount("descuentos", 12, 2, default=0),
            amount("ingreso_bruto", 12, 2, null=True),
            amount("ingreso_neto", 12, 2, null=True),
            text("comprador", 120, null=True),
            text("notas", 255, null=True),
            _CREATED,
        ),
        generated={
            "ingreso_bruto": ("total_litros * precio_litro", "decimal(12,2)"),
            "ingreso_neto": ("total_litros * precio_litro - descuentos", "decimal(12,2)"),
        },
    ),
]

_ALERTS = [
    Table(
        "tbl_alerta",
        (
            key("id_alerta"),
            choice("modulo", D.MODULO_ALERTA),
            _animal_ref(null=True),
            big("id_origen"),
            text("tipo", 120),
            text("descripcion", null=True),
            choice("prioridad", D.PRIORIDAD, "Normal"),
            day("fecha_programada"),
            choice("estado", D.ESTADO_ALERTA, "Pendiente"),
            text("url_destino", 255, null=True),
            flag("enviar_correo", False),
            flag("correo_enviado", False),
            flag("notificacion_vista", False),
            moment("fecha_atendida", null=True),
            _user_ref("id_usuario_atiende"),
            _CREATED,
        ),
    ),
]

_LOGS = [
    Table(
        "tbl_auditoria_alerta",
        (
            key("id_auditoria"),
            ref("id_alerta", "tbl_alerta", SET_NULL, null=True, type=LONG),
            text("modulo", 50),
            integer("id_animal", null=True),
            big("id_origen"),
            text("tipo", 120),
            text("descripcion", null=True),
            text("prioridad", 20),
            day("fecha_programada"),
            text("estado_anterior", 20),
            text("estado_nuevo", 20, null=True),
            choice("accion_auditoria", D.ACCION_ALERTA, "Creada"),
            stamp("fecha_auditoria"),
            text("usuario_auditor", 100, null=True),
        ),
    ),
    Table(
        "tbl_bitacora",
        (
            key("id_bitacora"),
            _user_ref(),
            text("accion", 50),
            text("tabla_afectada", 80),
            text("id_registro", 40, null=True),
            text("detalle", null=True),
            text("ip_cliente", 45, null=True),
            stamp("fecha_accion"),
        ),
    ),
]

TABLES: dict[str, Table] = {
    t.name: t
    for group in (
        _PEOPLE,
        _CATALOGUES,
        _ANIMALS,
        _HEALTH,
        _REPRODUCTION,
        _EXITS,
        _SUPPLIES,
        _FINANCE,
        _ALERTS,
        _LOGS,
    )
    for t in group
}

# Written only by the edit commands of the reproductive cycle; it has no key.
AUDITORIA_CICLO = T.StructType(
    [
        T.StructField("id_ciclo", INT, False),
        T.StructField("id_usuario", INT),
        T.StructField("fase_editada", T.StringType(), False),
        T.StructField("campo_modificado", T.StringType(), False),
        T.StructField("valor_anterior", T.StringType()),
        T.StructField("valor_nuevo", T.StringType()),
        T.StructField("genero_cascada", T.BooleanType(), False),
        T.StructField("descripcion_cascada", T.StringType()),
    ]
)


def foreign_keys():
    """Every (child table, reference column) pair of the model."""
    return [(t, c) for t in TABLES.values() for c in t.references]


def children_of(parent: str):
    return [(t, c) for t, c in foreign_keys() if c.parent == parent]
