"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and run from scratch (nothing is cached between runs): once
to warm up, then twice; the median of the timed runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hatospark.plans import registry  # noqa: E402

HEADLINES = [
    "animal_completo",
    "inventario_mangas",
    "produccion_reciente",
    "alertas_pendientes",
    "mortalidad",
    "stock_bajo",
    "auditoria_alertas",
    "resumen_financiero_mensual",
    "expediente_sanitario",
    "kpi_reproductivo",
    "proximos_eventos",
    "historial_reproductivo",
    "aplicar_pesajes",
    "aplicar_movimientos_manga",
    "scd2_vaca",
    "saldo_insumos",
    "auditar_alertas_cambio",
    "sincronizar_ciclos__tbl_vaca_detalle",
    "contabilizar_compras",
    "resolver_causas__resueltas",
    "liquidar_leche__tbl_transaccion_financiera",
    "registrar_palpacion1__tbl_ciclo_reproductivo",
    "fk_huerfanos",
    "claves_duplicadas",
    "checks_fila",
    "dominios_enum",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = registry.queries()
    seconds = {}
    for name in HEADLINES:
        times = []
        for _ in range(3):
            registry.forget()
            start = time.perf_counter()
            runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
